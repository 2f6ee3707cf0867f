"""Catalog operators (metadata as tables): K1–K5, J5–J7, F9–F11, A7–A9, U1.

The input is a *column catalog* DataFrame covering any number of tables;
collision checks, name resolution and reconciliation are joins and CASE
expressions over it — never a per-table loop on the driver.  Catalogs are
as large as the number of columns (not rows), so they are the broadcast
side wherever they meet data.
"""
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import KNOWN_MODEL_DIMENSIONS, SHORTENABLE_MODEL_PREFIX, vsize

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference semantics)
# ---------------------------------------------------------------------------
# Column names that suggest a vectorizer made them (case-insensitive, anchored).
VECTORIZER_PATTERNS = (
    r".*_vector$",
    r".*_embedding$",
    r".*_cleaned$",
    r".*_model$",
    r".*_created_at$",
    r".*_updated_at$",
    r".*_vector_v\d+$",
    r".*_embedding_v\d+$",
)
# Alternative-name generation: version suffixes _v2.._v9 (up to 3), numeric
# suffixes _2.._9 (up to 5 in total), then descriptive ones (up to 7 in total).
VERSION_SUFFIX_RANGE = (2, 9)
NUMERIC_SUFFIX_RANGE = (2, 9)
DESCRIPTIVE_SUFFIXES = ("_new", "_alt", "_updated", "_current")
MAX_VERSION_ALTS, MAX_NUMERIC_ALTS, MAX_ALTS = 3, 5, 7
# Prefix strategy (the reference's first prefix is its own product name; it is
# a parameter here, ``tool_prefix``).
PREFIXES = ("new_", "alt_", "v2_")
MAX_PREFIX_ALTS = 5
# Tables larger than this are flagged in a reconcile plan (large-table guard).
LARGE_TABLE_ROWS = 1_000_000

CATALOG_SCHEMA = T.StructType([
    T.StructField("database_name", T.StringType()),
    T.StructField("schema_name", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("spark_type", T.StringType()),
    T.StructField("is_nullable", T.BooleanType()),
    T.StructField("ordinal_position", T.IntegerType()),
    T.StructField("declared_dimension", T.IntegerType()),
])


def normalize_type(dt: T.DataType) -> str:
    """Spark type -> the catalog's standard type name."""
    if isinstance(dt, T.StringType):
        return "text"
    if isinstance(dt, T.IntegerType):
        return "integer"
    if isinstance(dt, T.LongType):
        return "bigint"
    if isinstance(dt, T.TimestampNTZType):
        return "timestamp"
    if isinstance(dt, T.TimestampType):
        return "timestamptz"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.FloatType, T.DoubleType)):
        return "vector"
    return "unknown"


def column_catalog(spark: SparkSession, tables: dict[str, DataFrame], database: str,
                   schema: str) -> DataFrame:
    """K1: one row per column of every table, with ``row_count`` and the
    vector width.

    The catalog is metadata (one row per column), built once: every table's
    row count and — only for vector columns without a declared width — the
    observed width (min = max of ``size``) come from one union job whose
    result has one row per table; nothing else reaches the driver, and later
    uses of the catalog never rescan the tables.  Parquet answers the counts
    from footers.
    """
    rows, stats = [], []
    for name, df in tables.items():
        undeclared = []
        for pos, f in enumerate(df.schema.fields, start=1):
            declared = f.metadata.get("vector_dimension") if f.metadata else None
            typ = normalize_type(f.dataType)
            rows.append([database, schema, name, f.name, typ, f.dataType.simpleString(),
                         f.nullable, pos, declared])
            if typ == "vector" and declared is None:
                undeclared.append(f.name)
        dims = F.array(*[F.struct(F.lit(c).alias("c"), F.min(vsize(c)).alias("lo"),
                                  F.max(vsize(c)).alias("hi")) for c in undeclared]) \
            if undeclared else F.array().cast("array<struct<c:string,lo:int,hi:int>>")
        stats.append(df.agg(F.count(F.lit(1)).alias("n"), dims.alias("dims"))
                       .select(F.lit(name).alias("t"), "n", "dims"))
    per_table = {r.t: r for r in reduce(DataFrame.unionByName, stats).collect()}
    out = []
    for r in rows:
        st = per_table[r[2]]
        observed = {d.c: (d.hi if d.lo == d.hi else None) for d in st.dims}
        dim = r[8] if r[8] is not None else observed.get(r[3])
        out.append((*r, int(st.n), r[4] == "vector", dim))
    schema_out = T.StructType(CATALOG_SCHEMA.fields + [
        T.StructField("row_count", T.LongType()), T.StructField("is_vector", T.BooleanType()),
        T.StructField("dimension", T.IntegerType())])
    return spark.createDataFrame(out, schema_out)


# --- A8 / A9 / U1 ----------------------------------------------------------------

def vector_tables(catalog: DataFrame) -> DataFrame:
    """Vector columns grouped per table."""
    return catalog.filter("is_vector").groupBy("schema_name", "table_name") \
        .agg(F.sort_array(F.collect_list("column_name")).alias("vector_columns"))


def table_status(catalog: DataFrame, configured: DataFrame) -> DataFrame:
    """Per configured table: exists, row count, any ``*_vector`` column."""
    per_table = catalog.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"),
        F.bool_or(F.col("column_name").like(r"%\_vector")).alias("has_vector_column"))
    return configured.select("table_name").distinct().join(per_table, "table_name", "left") \
        .select("table_name", F.col("row_count").isNotNull().alias("exists"),
                F.coalesce("row_count", F.lit(0)).alias("row_count"),
                F.coalesce("has_vector_column", F.lit(False)).alias("has_vector_column"))


def missing_components(required: DataFrame, existing: DataFrame) -> DataFrame:
    """Required − existing (multiset difference)."""
    return required.exceptAll(existing)


# --- F9 / F10 / F11 / J5 ---------------------------------------------------------

def _names(name: Column, suffixes: list[str]) -> Column:
    return F.array(*[F.concat(name, F.lit(s)) for s in suffixes])


def alternative_names(name: Column, existing: Column) -> Column:
    """up to 7 free alternatives, in generation order (suffix strategy)."""
    v0, v1 = VERSION_SUFFIX_RANGE
    n0, n1 = NUMERIC_SUFFIX_RANGE
    vers = F.slice(F.array_except(_names(name, [f"_v{i}" for i in range(v0, v1 + 1)]), existing),
                   1, MAX_VERSION_ALTS)
    nums = F.array_except(_names(name, [f"_{i}" for i in range(n0, n1 + 1)]),
                          F.concat(existing, vers))
    nums = F.slice(nums, 1, F.greatest(F.lit(MAX_NUMERIC_ALTS) - F.size(vers), F.lit(0)))
    desc = F.array_except(_names(name, list(DESCRIPTIVE_SUFFIXES)),
                          F.concat(existing, vers, nums))
    desc = F.slice(desc, 1, F.greatest(F.lit(MAX_ALTS) - F.size(vers) - F.size(nums), F.lit(0)))
    return F.slice(F.concat(vers, nums, desc), 1, MAX_ALTS)


def prefix_alternatives(name: Column, existing: Column, tool_prefix: str | None = None
                        ) -> Column:
    """F9, prefix strategy: ``{prefix}{name}`` candidates not in use (max 5)."""
    prefixes = ([tool_prefix] if tool_prefix else []) + list(PREFIXES)
    cands = F.array(*[F.concat(F.lit(p), name) for p in prefixes])
    return F.slice(F.array_except(cands, existing), 1, MAX_PREFIX_ALTS)


def matches_vectorizer_pattern(name: Column) -> Column:
    return name.rlike("(?i)^(?:" + "|".join(VECTORIZER_PATTERNS) + ")")


def matched_pattern(name: Column) -> Column:
    out = None
    for p in VECTORIZER_PATTERNS:
        cond = name.rlike("(?i)^(?:" + p + ")")
        out = F.when(cond, F.lit(p)) if out is None else out.when(cond, F.lit(p))
    return out


def history_keys(registry: DataFrame, collision_log: DataFrame) -> DataFrame:
    """J5 prep: (schema, table, column) known to the registry — as original
    *or* actual name — or to the collision log.  The OR condition becomes a
    union of equi keys, so the membership test is a plain semi join."""
    k = ["schema_name", "table_name"]
    return (registry.select(*k, F.col("original_column_name").alias("column_name"))
            .unionByName(registry.select(*k, F.col("actual_column_name").alias("column_name")))
            .unionByName(collision_log.select(*k, F.col("desired_column_name")
                                              .alias("column_name")))
            .distinct())


def classify_collisions(desired: DataFrame, catalog: DataFrame, history: DataFrame | None
                        ) -> DataFrame:
    """severity / type per desired (schema, table, column).

    no column → safe/no_collision; vector column → critical/existing_vector;
    history → critical/previous_vectorizer; name pattern → warning/
    vectorizer_pattern; else info/unrelated_column.  Alternatives (F9) are
    generated for critical and warning collisions.
    """
    k = ["schema_name", "table_name"]
    cols = catalog.select(*k, "column_name", F.col("data_type").alias("existing_column_type"),
                          "is_vector", "dimension")
    existing = catalog.groupBy(*k).agg(F.collect_set("column_name").alias("existing_columns"))
    d = desired.join(cols, [*k, "column_name"], "left")
    if history is not None:
        # history comes from logs: no hint, the planner / AQE sizes it at run time
        d = d.join(history.withColumn("has_history", F.lit(True)), [*k, "column_name"], "left")
    else:
        d = d.withColumn("has_history", F.lit(None).cast("boolean"))
    d = d.join(existing, k, "left")
    name = F.col("column_name")
    exists = F.col("existing_column_type").isNotNull()
    ctype = (F.when(~exists, "no_collision").when(F.col("is_vector"), "existing_vector")
              .when(F.coalesce("has_history", F.lit(False)), "previous_vectorizer")
              .when(matches_vectorizer_pattern(name), "vectorizer_pattern")
              .otherwise("unrelated_column"))
    sev = (F.when(ctype == "no_collision", "safe")
            .when(ctype.isin("existing_vector", "previous_vectorizer"), "critical")
            .when(ctype == "vectorizer_pattern", "warning").otherwise("info"))
    details = F.concat(ctype, F.coalesce(F.concat(F.lit(": "), "existing_column_type"), F.lit("")))
    d = d.withColumn("collision_type", ctype).withColumn("severity", sev) \
         .withColumn("details", details) \
         .withColumn("matched_pattern", F.when(ctype == "vectorizer_pattern", matched_pattern(name)))
    alts = alternative_names(name, F.coalesce("existing_columns", F.array().cast("array<string>")))
    return d.withColumn("alternative_names",
                        F.when(F.col("severity").isin("critical", "warning"), alts)
                         .otherwise(F.array().cast("array<string>"))) \
            .drop("existing_columns", "is_vector")


def resolve_columns(collisions: DataFrame, fallback_suffix: str = "_v2",
                    safe_mode: bool = True) -> DataFrame:
    """resolved name (safe → desired; else the first alternative; none →
    ``{name}{fallback_suffix}``) and a ``blocked`` flag (critical in safe
    mode) instead of raising."""
    first = F.try_element_at(F.col("alternative_names"), F.lit(1))
    resolved = F.when(F.col("severity") == "safe", F.col("column_name")) \
                .otherwise(F.coalesce(first, F.concat("column_name", F.lit(fallback_suffix))))
    blocked = (F.col("severity") == "critical") & F.lit(safe_mode)
    strategy = F.when(F.col("severity") == "safe", "none") \
                .when(first.isNotNull(), "alternative_name").otherwise("suffix")
    return collisions.withColumn("resolved_column_name", resolved) \
                     .withColumn("resolution_strategy", strategy) \
                     .withColumn("blocked", blocked)


def collision_summary(collisions: DataFrame) -> DataFrame:
    """Counts by severity and type, critical list, safe flag (per table)."""
    sev, typ = F.col("severity"), F.col("collision_type")
    return collisions.groupBy("schema_name", "table_name").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(sev == s).alias(f"n_{s}") for s in ("critical", "warning", "info", "safe")],
        *[F.count_if(typ == t).alias(f"n_{t}") for t in
          ("existing_vector", "previous_vectorizer", "vectorizer_pattern", "unrelated_column",
           "no_collision")],
        F.sort_array(F.collect_set(F.when(sev == "critical", F.col("column_name"))))
         .alias("critical_columns"),
        (~F.bool_or(sev == "critical")).alias("safe_to_proceed"))


def collision_log_rows(resolved: DataFrame, occurred_at: str, config_key: str) -> DataFrame:
    """K5: collision-log rows from classified + resolved collisions."""
    return resolved.filter(F.col("severity") != "safe").select(
        F.lit(occurred_at).cast("timestamp_ntz").alias("occurred_at"), "database_name",
        "schema_name", "table_name", F.col("column_name").alias("desired_column_name"),
        "existing_column_type",
        F.to_json(F.struct("existing_column_type", "dimension")).alias("existing_column_info"),
        F.col("severity").alias("collision_severity"), "collision_type",
        "resolution_strategy", "resolved_column_name", F.lit(False).alias("alert_sent"),
        F.lit(config_key).alias("config_key"), "details")


# --- K3 / K4 / J6 / J7 ------------------------------------------------------------

def role_family(role: Column) -> Column:
    """The registry's type of a column role: cleaned text, its config and time are one."""
    return F.when(role.startswith("cleaned"), "cleaned").otherwise(role)


def column_mapping(desired: DataFrame, registry: DataFrame) -> DataFrame:
    """K3: actual column per (table, role); falls back to the default name.

    The registry (K2) files all cleaned-text columns under one type, so both
    sides are compared by that family; the original name tells them apart.
    """
    reg = registry.select("schema_name", "table_name",
                          role_family(F.col("column_type")).alias("_family"),
                          F.col("original_column_name").alias("column_name"),
                          "actual_column_name")
    return desired.withColumn("_family", role_family(F.col("role"))) \
        .join(reg, ["schema_name", "table_name", "_family", "column_name"], "left") \
        .withColumn("actual_column_name", F.coalesce("actual_column_name", "column_name")) \
        .drop("_family")


def reconcile_plan(resolved: DataFrame, catalog: DataFrame, dry_run: bool = True) -> DataFrame:
    """K4: companion columns that must be added, one ALTER per row, with the
    large-table guard and the blocked flag."""
    k = ["schema_name", "table_name"]
    present = catalog.select(*k, F.col("column_name").alias("resolved_column_name"),
                             F.lit(True).alias("_present"))
    rows = catalog.groupBy(*k).agg(F.max("row_count").alias("row_count"))
    p = resolved.join(present, [*k, "resolved_column_name"], "left") \
                .join(rows, k, "left")
    todo = p.filter(F.col("_present").isNull())
    ddl = F.concat(F.lit("ALTER TABLE "), F.col("schema_name"), F.lit("."), F.col("table_name"),
                   F.lit(" ADD COLUMN "), F.col("resolved_column_name"), F.lit(" "),
                   F.col("column_type"))
    return todo.select(*k, "column_name", "role", "resolved_column_name", "column_type",
                       ddl.alias("ddl"), "blocked",
                       (F.coalesce("row_count", F.lit(0)) > LARGE_TABLE_ROWS).alias("large_table"),
                       F.lit(dry_run).alias("dry_run"))


def schema_drift(expected: DataFrame, catalog: DataFrame) -> DataFrame:
    """Expected companion columns ⟗ actual columns → drift rows
    (missing_column / wrong_type / dimension_mismatch)."""
    k = ["schema_name", "table_name", "column_name"]
    a = catalog.select(*k, F.col("data_type").alias("actual_type"),
                       F.col("dimension").alias("actual_dimension"))
    e = expected.select(*k, "expected_type", "expected_dimension")
    j = e.join(a, k, "left")
    kind = (F.when(F.col("actual_type").isNull(), "missing_column")
             .when(F.col("actual_type") != F.col("expected_type"), "wrong_type")
             .when(F.col("expected_dimension").isNotNull()
                   & ~F.col("expected_dimension").eqNullSafe(F.col("actual_dimension")),
                   "dimension_mismatch"))
    return j.withColumn("drift_type", kind).filter(F.col("drift_type").isNotNull())


def known_dimensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN_MODEL_DIMENSIONS.items()),
                                 "model string, known_dimension int")


def model_dimension_check(configs: DataFrame, known: DataFrame) -> DataFrame:
    """Configured (model, dimensions) ⟕ known widths → ok / mismatch /
    unknown / exceeds_max (narrower is fine for shortenable models)."""
    j = configs.join(known, "model", "left")
    kd, d = F.col("known_dimension"), F.col("dimensions")
    short = F.col("model").startswith(SHORTENABLE_MODEL_PREFIX)
    status = (F.when(kd.isNull(), "unknown").when(d == kd, "ok")
               .when(short & (d > kd), "exceeds_max").when(short, "ok").otherwise("mismatch"))
    return j.withColumn("status", status)


# --- P10 ------------------------------------------------------------------------------

def add_missing_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """P10: companion columns (name → SQL type) added as typed NULLs, only
    where the DataFrame lacks them; existing columns and values are kept."""
    add = {c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns}
    return df.withColumns(add) if add else df


def alter_table_add_columns(spark: SparkSession, table: str, wanted: dict[str, str],
                            dry_run: bool = False) -> list[str]:
    """P10 for a catalog table: ``ALTER TABLE … ADD COLUMNS`` for the missing
    companions only (idempotent).  Returns the statements (run unless
    ``dry_run``)."""
    have = set(spark.table(table).columns)
    missing = [(c, t) for c, t in wanted.items() if c not in have]
    if not missing:
        return []
    stmt = f"ALTER TABLE {table} ADD COLUMNS (" + ", ".join(f"{c} {t}" for c, t in missing) + ")"
    if not dry_run:
        spark.sql(stmt)
    return [stmt]
