"""Flagship job: backfill NULL vectors and report completion.

documents ⟕ embeddings → P2 (NULL vectors) → F1 → P3 (blank skip) → F18 →
P8 (validity) → S4 (write back) → A1/A2 per language.

Physical plan: one sort-merge (or AQE-chosen) join of the user table with
its stored vectors, then a single projection that computes the new vector
only for rows that need one (``when`` short-circuits, so rows that already
have a vector never pay for cleaning or embedding), then one partial/final
aggregation.  No second join is needed for the write-back because the
rows to update and the rows to report are the same rows.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import basic_clean
from ..functions.vectors import mock_embedding, vector_status
from ..operators.monitor import completion_pct
from . import derive


def backfill_vectors(user: DataFrame, text_col: str = "text",
                     vector_col: str = "text_vector",
                     model_col: str = "text_embedding_model",
                     created_col: str = "text_vector_created_at",
                     dimension: int = derive.DIMENSION,
                     model: str = derive.CURRENT_MODEL,
                     as_of: str = derive.AS_OF,
                     clean: Callable[[Column], Column] = basic_clean,
                     embed: Callable[[Column, int], Column] = mock_embedding) -> DataFrame:
    """Rows of ``user`` with NULL vectors get a cleaned-text embedding.

    Adds ``backfill_status``: 'present' (had a vector), 'skipped' (blank after
    cleaning), 'created', or the P8 label of an invalid vector (kept NULL).
    """
    v = F.col(vector_col)
    cleaned = clean(F.col(text_col))
    needs = v.isNull()
    df = user.withColumn("_needs", needs).withColumn(
        "_clean", F.when(F.col("_needs"), cleaned))
    new_vec = F.when(F.col("_needs") & (F.col("_clean") != ""), embed(F.col("_clean"), dimension))
    df = df.withColumn("_new", new_vec).withColumn("_vstat", vector_status(F.col("_new"), dimension))
    status = (F.when(~F.col("_needs"), "present")
               .when(F.col("_clean") == "", "skipped")
               .when(F.col("_vstat") == "ok", "created")
               .otherwise(F.col("_vstat")))
    created = status == "created"
    return (df.withColumn("backfill_status", status)
              .withColumn(vector_col, F.when(created, F.col("_new")).otherwise(v))
              .withColumn(model_col, F.when(created, F.lit(model)).otherwise(F.col(model_col)))
              .withColumn(created_col, F.when(created, F.lit(as_of).cast("timestamp_ntz"))
                          .otherwise(F.col(created_col)))
              .drop("_needs", "_clean", "_new", "_vstat"))


def backfill_status_udf(user: DataFrame, text_col: str = "text",
                        vector_col: str = "text_vector", dimension: int = derive.DIMENSION,
                        clean: Callable[[Column], Column] = basic_clean,
                        provider: str = "mock", keep: tuple[str, ...] = ("lang",),
                        **embedder_config) -> DataFrame:
    """Backfill statuses with the Arrow embedder (UD1) instead of a native
    expression.  Only (id, kept columns, flag, cleaned text of the rows that
    need a vector) cross into Python; stored vectors never do."""
    from ..operators.embed import embed_column

    needs = F.col(vector_col).isNull()
    cleaned = F.when(needs, clean(F.col(text_col)))
    base = user.select(*keep, needs.alias("_needs"), cleaned.alias("_clean"))
    todo = base.withColumn("_send", F.when(F.col("_clean") != "", F.col("_clean")))
    e = embed_column(todo.drop("_clean"), "_send", "_new", provider, dimension=dimension,
                     **embedder_config)
    vstat = vector_status(F.col("_new"), dimension)
    status = (F.when(~F.col("_needs"), "present")
               .when(F.col("_send").isNull(), "skipped")
               .when(vstat == "ok", "created").otherwise(vstat))
    return e.select(*keep, status.alias("backfill_status"))


def completion_after_backfill(documents: DataFrame, embeddings: DataFrame,
                              dimension: int = derive.DIMENSION,
                              embedder: str = "native") -> DataFrame:
    """After backfill, what is the completion per language and how many
    vectors were created?  ``embedder`` = 'native' (F18 as an expression)
    or 'udf' (the Arrow embedder, UD1)."""
    user = derive.user_table(documents, embeddings)
    if embedder == "udf":
        done = backfill_status_udf(user, dimension=dimension)
    else:
        done = backfill_vectors(user, dimension=dimension)
    st = F.col("backfill_status")
    g = done.groupBy("lang").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(st != "present").alias("null_before"),
        F.count_if(st == "created").alias("vectors_created"),
        F.count_if(st == "skipped").alias("skipped_blank"),
        F.count_if(~st.isin("present", "created", "skipped")).alias("invalid_vectors"),
        F.count_if(~st.isin("present", "created")).alias("null_after"))
    return g.select(
        "lang", "total_rows", "null_before", "vectors_created", "skipped_blank",
        "invalid_vectors", "null_after",
        completion_pct(F.col("null_before"), F.col("total_rows")).alias("completion_before"),
        completion_pct(F.col("null_after"), F.col("total_rows")).alias("completion_after"))


def backfill_write_back(user: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        vector_col: str = "text_vector",
                        model_col: str = "text_embedding_model",
                        created_col: str = "text_vector_created_at",
                        dimension: int = derive.DIMENSION, model: str = derive.CURRENT_MODEL,
                        as_of: str = derive.AS_OF, provider: str = "mock",
                        clean: Callable[[Column], Column] = basic_clean,
                        **embedder_config) -> DataFrame:
    """P2 → F1 → P3 → UD1 → P8 → S4 as a job with a side-effect boundary.

    The provider is called once per row: the new vectors are checkpointed
    into the shared checkpoint folder before the write-back join, so a lost
    executor or a re-planned join never re-runs the embedding calls.
    """
    from ..operators.embed import embed_column
    from ..operators.writeback import write_back
    from ..session import checkpoint_dir

    todo = (user.filter(F.col(vector_col).isNull())
                .select(id_col, clean(F.col(text_col)).alias("_clean"))
                .filter(F.col("_clean") != ""))
    emb = embed_column(todo.select(id_col, "_clean"), "_clean", "new_vector", provider,
                       dimension=dimension, **embedder_config).select(id_col, "new_vector")
    checkpoint_dir(user.sparkSession)
    emb = emb.checkpoint(eager=True)          # the side-effect boundary: nothing filters before it
    updates = emb.filter(vector_status(F.col("new_vector"), dimension) == "ok").select(
        id_col, "new_vector", F.lit(model).alias("new_model"),
        F.lit(as_of).cast("timestamp_ntz").alias("new_created_at"))
    return write_back(user, updates, id_col, vector_col, model_col, created_col)
