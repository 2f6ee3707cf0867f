"""A5 from stored sketches: health over any look-back without reading the log again.

For every table and day of the vectorization log one row is stored: counts by status, the sum
of latencies, a KLL sketch of the latencies of successes, HLL sketches of the rows and models
seen, the last time.  Sketches merge, so a look-back of any number of days reads that many
small rows: counts and means are exact, a percentile is off by at most ``kll_rank_error`` in
rank (at 99 % confidence), a distinct count by about 1.04 / sqrt(2 ** HLL_LG_K), 1.6 %.

Rows are stored by day (``day=<date>``): a new log extends the store by its days, a day written
again replaces its rows (dynamic overwrite), and a look-back opens only its own folders.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .monitor import KLL_K, TABLE_KEY, kll_rank_error

HLL_LG_K = 12


def daily_sketches(log: DataFrame, key: list[str] = TABLE_KEY) -> DataFrame:
    """One row per table and day: exact counts, sums and times, and the sketches."""
    ok = F.col("status") == "success"
    latency = F.when(ok, F.col("processing_time").cast("double"))
    return (log.withColumn("day", F.to_date("created_at")).groupBy(*key, "day").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count(latency).alias("timed"), F.sum(latency).alias("latency_sum"),
        F.max("created_at").alias("last_vectorization"),
        F.kll_sketch_agg_double(latency, KLL_K).alias("latency"),
        F.hll_sketch_agg(F.col("row_id"), HLL_LG_K).alias("rows"),
        F.hll_sketch_agg(F.col("embedding_model"), HLL_LG_K).alias("models")))


def store_sketches(log: DataFrame, path: str, key: list[str] = TABLE_KEY) -> None:
    """Write the days of ``log`` to the store ``path``; days that are there are replaced."""
    (daily_sketches(log, key).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def health_between(spark: SparkSession, path: str, first_day: str, last_day: str,
                   quantile: float = 0.95, key: list[str] = TABLE_KEY) -> DataFrame:
    """Health per table over the days from ``first_day`` to ``last_day``, merged from the
    store: total, successful, failed, avg_ms, last_vectorization (exact), and p_ms with the
    bounds p_low_ms, p_high_ms, distinct_rows, distinct_models (sketched)."""
    e = kll_rank_error()
    days = spark.read.parquet(path).filter(F.col("day").between(
        F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    merged = days.groupBy(*key).agg(
        F.sum("total").alias("total"), F.sum("successful").alias("successful"),
        F.sum("failed").alias("failed"),
        (F.sum("latency_sum") / F.sum("timed")).alias("avg_ms"),
        F.max("last_vectorization").alias("last_vectorization"),
        F.kll_merge_agg_double("latency", KLL_K).alias("_l"),
        F.hll_sketch_estimate(F.hll_union_agg("rows")).alias("distinct_rows"),
        F.hll_sketch_estimate(F.hll_union_agg("models")).alias("distinct_models"),
        F.sum("timed").alias("_timed"))
    marks = F.when(F.col("_timed") > 0, F.kll_sketch_get_quantile_double("_l", F.array(
        *[F.lit(min(1.0, max(0.0, quantile + d))) for d in (-e, 0.0, e)])))
    return (merged.withColumn("_m", marks)
            .withColumns({name: F.get("_m", F.lit(i)) for i, name in
                          enumerate(("p_low_ms", "p_ms", "p_high_ms"))})
            .drop("_m", "_l", "_timed"))
