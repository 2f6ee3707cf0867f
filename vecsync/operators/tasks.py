"""Task table operators: T1, F17 (table form), W5, S7 split, ST7 requests."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.errors import retry_schedule
from ..functions.time import epoch_us

# Fixed value: priority order of the task queue.
PRIORITY_RANK = {"high": 0, "medium": 1, "low": 2}


def priority_rank(p: Column) -> Column:
    r = None
    for name, rank in PRIORITY_RANK.items():
        r = F.when(p == name, rank) if r is None else r.when(p == name, rank)
    return r.otherwise(len(PRIORITY_RANK))


def next_tasks(tasks: DataFrame, as_of, n: int) -> DataFrame:
    """The ``n`` due pending tasks in queue order (priority, scheduled_at, id).
    Planned as TakeOrderedAndProject: each task keeps its top n, the driver
    merges n × partitions rows."""
    a = F.lit(as_of).cast("timestamp_ntz")
    due = tasks.filter((F.col("status") == "pending") & (F.col("scheduled_at") <= a))
    return due.orderBy(priority_rank(F.col("priority")), F.col("scheduled_at"), F.col("id")) \
              .limit(n)


def schedule_retries(failed: DataFrame, retry_delay: float, max_retries: int,
                     failed_at: str = "completed_at") -> DataFrame:
    """F17 over a table of failed tasks."""
    s = retry_schedule(F.col(failed_at), F.col("retry_count"), retry_delay, max_retries)
    return failed.withColumn("_s", s).select("*", "_s.*").drop("_s")


def attempt_history(log: DataFrame, key: list[str], ts_col: str, tiebreak: str,
                    failed: Column, bucket_seconds: int = 86400) -> DataFrame:
    """Attempt number and failures before each attempt, per task key.

    A key may hold a third of the log, so the running count / sum is split
    by time bucket: each (key, bucket) is numbered on its own, and the first
    row of each bucket carries the bucket's totals, from which a small
    per-key window derives the offsets of earlier buckets.  The log is read
    twice, the second time only its key, time and outcome.  Exact for any
    bucket size.
    """
    ts_us = epoch_us(F.col(ts_col))
    x = (log.withColumn("_b", F.floor(ts_us / F.lit(bucket_seconds * 1_000_000)))
            .withColumn("_f", failed.cast("int")))
    part = Window.partitionBy(*key, "_b")
    w = part.orderBy(F.col(ts_col), F.col(tiebreak))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    y = (x.withColumn("_rn", F.row_number().over(w))
          .withColumn("_fb", F.coalesce(F.sum("_f").over(before), F.lit(0)))
          .withColumn("_n", F.count(F.lit(1)).over(part))
          .withColumn("_s", F.sum("_f").over(part)))
    wb = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = (y.filter(F.col("_rn") == 1).select(*key, "_b", "_n", "_s")
             .withColumn("_on", F.coalesce(F.sum("_n").over(wb), F.lit(0)))
             .withColumn("_os", F.coalesce(F.sum("_s").over(wb), F.lit(0)))
             .select(*key, "_b", "_on", "_os"))
    return (y.join(offs, [*key, "_b"])
             .withColumn("attempt_no", (F.col("_on") + F.col("_rn")).cast("int"))
             .withColumn("failures_before", (F.col("_os") + F.col("_fb")).cast("long"))
             .drop("_b", "_f", "_rn", "_fb", "_n", "_s", "_on", "_os"))


def backfill_requests(null_counts: DataFrame) -> DataFrame:
    """ST7: one low-priority bulk request per target that still has NULL vectors."""
    req = null_counts.filter(F.col("null_vectors") > 0)
    payload = F.to_json(F.struct(
        F.col("database_name").alias("database"), F.col("schema_name").alias("schema"),
        F.col("table_name").alias("table"), F.col("vector_column"),
        F.col("null_vectors").alias("null_count"), F.lit("low").alias("priority")))
    return req.select("database_name", "schema_name", "table_name", "vector_column",
                      F.col("null_vectors").alias("null_count"),
                      F.lit("low").alias("priority"), payload.alias("payload"))
