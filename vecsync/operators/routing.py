"""Routing: J1, J3, F6, P11.

The routing table holds one row per vectorization target (the reference's
table configs) and is broadcast: dealt out by its key, the rows of a table
would all meet in one task, and adaptive execution does not undo that where
the few keys leave most partitions empty.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C

KEY = ["_db", "schema", "table"]


def route_keys(routing: DataFrame) -> DataFrame:
    """J1 prep: each config answers to its config name *and* its physical
    database name; per (db, schema, table) the first config (by order) wins."""
    aliases = routing.select(
        F.explode(F.array_distinct(F.array("database", "database_name"))).alias("_db"),
        *[c for c in routing.columns])
    w = Window.partitionBy(*KEY).orderBy("config_order")
    return aliases.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def route_events(events: DataFrame, routing: DataFrame) -> DataFrame:
    """Events ⋈ routing on (database alias, schema, table); the event's
    columns plus the winning config's columns (``config_name`` = its name)."""
    return _route(events, routing, "inner")


def _route(events: DataFrame, routing: DataFrame, how: str) -> DataFrame:
    r = route_keys(routing)
    r = r.select(F.col("_db").alias("_r_db"), F.col("schema").alias("_r_schema"),
                 F.col("table").alias("_r_table"),
                 F.col("database").alias("config_name"),
                 *[c for c in routing.columns if c not in ("database", "schema", "table")])
    cond = [(events["database"] == r["_r_db"]), (events["schema"] == r["_r_schema"]),
            (events["table"] == r["_r_table"])]
    out = events.join(F.broadcast(r), cond, how)
    return out.drop("_r_db", "_r_schema", "_r_table")


def unrouted_events(events: DataFrame, routing: DataFrame) -> DataFrame:
    """Events no config matches (left anti join)."""
    return _route(events, routing, "left_anti")


def desired_columns(routing: DataFrame) -> DataFrame:
    """The companion columns each target needs, one row per (target, column).

    vector ``{text}_vector`` (or the configured name), model
    ``{text}_embedding_model`` (Q1), timestamp ``{vector}_created_at`` and,
    with cleaning on, ``{text}_cleaned`` + ``_config`` + ``_at``.
    """
    vec = F.coalesce(F.col("vector_column"), F.concat(F.col("text_column"), F.lit("_vector")))
    model = F.coalesce(F.col("model_column"),
                       F.concat(F.col("text_column"), F.lit("_embedding_model")))
    cleaned = F.concat(F.col("text_column"), F.lit("_cleaned"))
    items = [F.struct(vec.alias("column_name"), F.lit("vector").alias("role")),
             F.struct(model.alias("column_name"), F.lit("model").alias("role")),
             F.struct(F.concat(vec, F.lit("_created_at")).alias("column_name"),
                      F.lit("timestamp").alias("role"))]
    clean_items = [F.struct(cleaned.alias("column_name"), F.lit("cleaned").alias("role")),
                   F.struct(F.concat(cleaned, F.lit("_config")).alias("column_name"),
                            F.lit("cleaned_config").alias("role")),
                   F.struct(F.concat(cleaned, F.lit("_at")).alias("column_name"),
                            F.lit("cleaned_timestamp").alias("role"))]
    arr = F.when(F.coalesce(F.col("cleaning_enabled"), F.lit(False)),
                 F.array(*items, *clean_items)).otherwise(F.array(*items))
    return (routing.select("config_order", "database", "database_name", "schema", "table",
                           "text_column", "embedding_config", F.explode(arr).alias("c"))
                   .select("config_order", "database", "database_name", "schema", "table",
                           "text_column", "embedding_config", "c.column_name", "c.role"))


def clean_by_config(text: Column, enabled: Column, pipeline_name: Column) -> Column:
    """per-row cleaning choice.  Disabled → original text; a known preset
    → that pipeline; anything else (missing / unknown) → basic.

    All branches are native expressions in one CASE, so a mixed batch of
    targets is cleaned in one projection.
    """
    branches = None
    for name, steps in C.PRESETS.items():
        fn = C.pipeline(steps)
        cond = pipeline_name == name
        # what a step evaluates beside the CASE (the tokenizer) sees the rows of its preset only
        own = fn(F.when(cond, text))
        branches = F.when(cond, own) if branches is None else branches.when(cond, own)
    chosen = branches.otherwise(C.basic_clean(text))
    return F.when(F.coalesce(enabled, F.lit(False)), chosen).otherwise(text)
