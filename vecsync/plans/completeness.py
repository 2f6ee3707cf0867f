"""Completeness job: A1 → A2 → S6 → T2 (+ ST7 requests).

Counts NULL vectors per target in one scan of each table, upserts the day's
check into the status history (a later check the same day replaces the
earlier one), and reports the latest check per target worst-first with
health and freshness labels.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import monitor as M
from ..operators import tasks as TK
from ..operators import writeback as WB


def check_rows(null_counts: DataFrame, checked_at: str, config_key: str = "default"
               ) -> DataFrame:
    """A1 results → null_vector_status rows for one check time."""
    return null_counts.select(
        F.lit(checked_at).cast("timestamp_ntz").alias("checked_at"), "database_name",
        "schema_name", "table_name", "vector_column", F.lit(config_key).alias("config_key"),
        F.col("null_vectors").cast("long").alias("null_vectors"),
        F.col("total_rows").cast("long").alias("total_rows"),
        F.lit(None).cast("timestamp_ntz").alias("last_vectorized_at"))


def completeness_report(null_counts: DataFrame, history: DataFrame, checked_at: str,
                        as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (new status table, completion summary, backfill requests)."""
    status = WB.upsert_daily_status(history, check_rows(null_counts, checked_at))
    summary = M.completion_summary(status.drop("completion_percentage"), as_of)
    requests = TK.backfill_requests(null_counts)
    return status, summary, requests
