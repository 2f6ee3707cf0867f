"""Sinks: S4 write-back, S5 log rows, S6 daily status upsert, S7 dead letter, K2.

Plain Parquet has no UPDATE: the write-back is a left join of the table
with the new vectors + ``coalesce(new, old)`` written as a *new* snapshot
directory (never over the path being read).  On a V2 table format with
row-level operations ``DataFrame.mergeInto`` does the same in place.
Running the write-back twice with the same input changes nothing.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import vsize
from ..operators.monitor import completion_pct


def write_back(table: DataFrame, updates: DataFrame, id_col: str, vector_col: str,
               model_col: str, created_col: str, new_vector: str = "new_vector",
               new_model: str = "new_model", new_created: str = "new_created_at",
               guard_stale: bool = True) -> DataFrame:
    """Apply ``updates`` (id, new_vector, new_model, new_created_at) to ``table``.

    Ids missing from ``table`` are skipped (left join from the table side).
    With ``guard_stale`` an update older than the stored vector is ignored
    (late / replayed events, ST6).  Several updates per id: the newest wins;
    of equally new ones the greatest (model, vector).
    """
    w = Window.partitionBy(id_col).orderBy(F.col(new_created).desc(), F.col(new_model).desc(),
                                           F.col(new_vector).desc())
    latest = (updates.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
                     .select(id_col, new_vector, new_model, new_created))
    j = table.join(latest, id_col, "left")
    apply = F.col(new_vector).isNotNull()
    if guard_stale:
        apply = apply & (F.col(created_col).isNull() | (F.col(new_created) >= F.col(created_col)))
    out = (j.withColumn("_apply", apply)
            .withColumn(vector_col, F.when(F.col("_apply"), F.col(new_vector))
                        .otherwise(F.col(vector_col)))
            .withColumn(model_col, F.when(F.col("_apply"), F.col(new_model))
                        .otherwise(F.col(model_col)))
            .withColumn(created_col, F.when(F.col("_apply"), F.col(new_created))
                        .otherwise(F.col(created_col))))
    return out.drop("_apply", new_vector, new_model, new_created)


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Persist a snapshot (new directory per version)."""
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def log_rows(results: DataFrame, database: str, schema: str, table: str, text_column: str,
             vector_column: str, model: str, as_of, id_col: str, status_col: str,
             text_col: str, vector_col: str) -> DataFrame:
    """One vectorization-log row per attempt."""
    return results.select(
        F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
        F.lit(database).alias("database_name"), F.lit(schema).alias("schema_name"),
        F.lit(table).alias("table_name"),
        F.to_json(F.struct(F.col(id_col).alias("id"))).alias("row_id"),
        F.lit(text_column).alias("text_column"), F.lit(vector_column).alias("vector_column"),
        F.lit(model).alias("embedding_model"),
        F.col(status_col).alias("status"),
        F.length(F.col(text_col)).alias("text_length"),
        vsize(vector_col).alias("vector_dimension"))


def append_log(rows: DataFrame, path: str, batch_id: int, ts_col: str = "created_at") -> None:
    """Add a batch of log rows to the date-partitioned log at ``path``
    (``log_date=<day>/batch_id=<n>``).  A replayed batch replaces its own partitions and no
    others; rows without a time lie in the null date."""
    (rows.withColumn("log_date", F.to_date(ts_col)).withColumn("batch_id", F.lit(batch_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("log_date", "batch_id").parquet(path))


def read_log(spark, path: str, first_day: str | None = None, last_day: str | None = None
             ) -> DataFrame:
    """The log, or its rows of some days: only their folders are opened."""
    log = spark.read.parquet(path)
    if first_day is not None:
        log = log.filter(F.col("log_date") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        log = log.filter(F.col("log_date") <= F.lit(last_day).cast("date"))
    return log


def upsert_daily_status(history: DataFrame, checks: DataFrame,
                        key: tuple[str, ...] = ("database_name", "schema_name", "table_name",
                                                "vector_column")) -> DataFrame:
    """A later check on the same day replaces the earlier one; one row
    per (key, day).  Union + ``row_number`` per (key, to_date(checked_at));
    equally late checks are told apart by their other columns, greatest first."""
    cols = history.columns
    both = history.unionByName(checks.select(*cols))
    w = Window.partitionBy(*key, F.to_date("checked_at")).orderBy(
        F.col("checked_at").desc(),
        *[F.col(c).desc() for c in cols if c not in (*key, "checked_at")])
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn") \
               .withColumn("completion_percentage",
                           completion_pct(F.col("null_vectors"), F.col("total_rows")))


def split_dead_letter(failed: DataFrame, retry_count: Column, max_retries: Column | int
                      ) -> tuple[DataFrame, DataFrame]:
    """(to_retry, dead_letter).  Exhausted tasks go to a second sink
    instead of being dropped."""
    mr = max_retries if isinstance(max_retries, Column) else F.lit(max_retries)
    dead = retry_count >= mr
    return failed.filter(~dead), failed.filter(dead)


def upsert_registry(registry: DataFrame, new_rows: DataFrame) -> DataFrame:
    """K2: registry upsert, unique on (db, schema, table, actual column);
    the newer row wins."""
    key = ["database_name", "schema_name", "table_name", "actual_column_name"]
    both = registry.unionByName(new_rows.select(*registry.columns))
    w = Window.partitionBy(*key).orderBy(F.col("created_at").desc())
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def write_bucketed_snapshot(df: DataFrame, table_name: str, id_col: str, buckets: int,
                            mode: str = "overwrite") -> None:
    """Persist a snapshot as a table bucketed and sorted by id.

    The next change detection (J2 full outer join) and the next write-back
    (S4 left join) against an equally bucketed table then join bucket by
    bucket with no shuffle of either side.
    """
    (df.repartition(buckets, id_col)
       .write.mode(mode).bucketBy(buckets, id_col).sortBy(id_col).saveAsTable(table_name))


def merge_vectors_into(updates: DataFrame, table_name: str, id_col: str, vector_col: str,
                       model_col: str, created_col: str, new_vector: str = "new_vector",
                       new_model: str = "new_model", new_created: str = "new_created_at",
                       guard_stale: bool = True) -> None:
    """S4 in place, for a table format with row-level operations (a V2
    catalog table): ``MERGE`` the newest update per id; missing ids are
    skipped, stale updates lose (as in ``write_back``)."""
    w = Window.partitionBy(id_col).orderBy(F.col(new_created).desc())
    src = (updates.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
                  .select(id_col, new_vector, new_model, new_created).alias("s"))
    tq = table_name.split(".")[-1]          # the target is addressed by its name
    t = F.col(f"{tq}.{created_col}")
    cond = F.col(f"{tq}.{id_col}") == F.col(f"s.{id_col}")
    fresh = (t.isNull() | (F.col(f"s.{new_created}") >= t)) if guard_stale else F.lit(True)
    (src.mergeInto(f"{table_name}", cond)
        .whenMatched(fresh)
        .update({vector_col: F.col(f"s.{new_vector}"), model_col: F.col(f"s.{new_model}"),
                 created_col: F.col(f"s.{new_created}")})
        .merge())
