"""Completeness and health roll-ups.

All roll-ups are single-pass aggregates (partial aggregation map-side, one
small shuffle of per-key partials).  Joins between logs happen only after
each log was reduced to one row per table key (fixes the fan-out of the
reference's 4-way join, quirk Q9).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import epoch_us

TABLE_KEY = ["database_name", "schema_name", "table_name"]


def _ts(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("timestamp_ntz")


# --- A1 / A2 -----------------------------------------------------------------

def null_vector_counts(df: DataFrame, vector_col: str, by: list[str] | None = None,
                       text_col: str | None = None, text_only: bool = False) -> DataFrame:
    """A1: NULL-vector count and total in one scan, per group.

    Every row counts, as the reference's code does (quirk Q7); with
    ``text_only`` only rows whose ``text_col`` is not NULL count.
    """
    if text_only:
        df = df.filter(F.col(text_col).isNotNull())
    aggs = [F.count_if(F.col(vector_col).isNull()).alias("null_vectors"),
            F.count(F.lit(1)).alias("total_rows")]
    return df.groupBy(*(by or [])).agg(*aggs)


def completion_pct(null_vectors: Column, total_rows: Column) -> Column:
    """A2: (total - null) / total * 100 as decimal(5,2), half-up; 100 when empty."""
    pct = F.round((total_rows - null_vectors).cast("decimal(20,0)") * F.lit(100)
                  / total_rows.cast("decimal(20,0)"), 2)
    return (F.when(total_rows > 0, pct).otherwise(F.lit(100))).cast("decimal(5,2)")


def health_status(pct: Column) -> Column:
    return (F.when(pct >= 95, "healthy").when(pct >= 80, "warning").otherwise("critical"))


def freshness_status(last_vectorized_at: Column, as_of) -> Column:
    """Labels of the completion view; NULL falls through to 'current' (Q10)."""
    a = _ts(as_of)
    return (F.when(last_vectorized_at < a - F.expr("INTERVAL 1 HOURS"), "stale")
             .when(last_vectorized_at < a - F.expr("INTERVAL 10 MINUTES"), "recent")
             .otherwise("current"))


# --- A4 / A5 / J4 --------------------------------------------------------------

def system_health(log: DataFrame, as_of) -> DataFrame:
    """A4: one-row roll-up of the last 24 h of the vectorization log."""
    a = _ts(as_of)
    recent = log.filter(F.col("created_at") > a - F.expr("INTERVAL 24 HOURS"))
    st = F.col("status")
    return recent.agg(
        F.count(F.lit(1)).alias("total_vectorizations"),
        F.count_if(st == "success").alias("successful"),
        F.count_if(st == "failed").alias("failed"),
        F.count_if(F.col("created_at") > a - F.expr("INTERVAL 1 HOURS")).alias("last_hour"),
        F.avg(F.when(st == "success", F.col("processing_time"))).alias("avg_processing_time_ms"),
        F.max("created_at").alias("last_vectorization"))


NARROW = 10_000


def _narrowed(values: DataFrame, rank: int, low: float, high: float, below: int
              ) -> tuple[float, float, int]:
    """Bounds around the value of ``rank`` (0-based over all values), closer than ``low`` and
    ``high``, and how many values are below the new lower one."""
    inside = values.filter((F.col("v") >= low) & (F.col("v") <= high))
    n = inside.count()
    at = (rank - below + 0.5) / n
    qs = [max(0.0, at - 0.001), at, min(1.0, at + 0.001)]
    found = inside.agg(F.percentile_approx("v", qs, 10000)).first()[0]
    marks = sorted({low, high, *found})
    counts = inside.agg(*[F.count_if(F.col("v") < m) for m in marks],
                        *[F.count_if(F.col("v") <= m) for m in marks]).first()
    under, upto = counts[:len(marks)], counts[len(marks):]
    want = rank - below
    for i, m in enumerate(marks):
        if under[i] <= want < upto[i]:
            return m, m, below + under[i]               # the value itself
    i = max(i for i, u in enumerate(upto) if u <= want)
    return marks[i], marks[i + 1], below + under[i]


def order_statistic(values: DataFrame, rank: int) -> float:
    """The value of ``rank`` (0-based) of the column ``v``: the interval that holds it is
    narrowed by sketches and counts until ``NARROW`` values at most are left."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    below = 0
    while low < high:
        inside = values.filter((F.col("v") >= low) & (F.col("v") <= high))
        # how often each value occurs; at most NARROW + 1 rows reach the driver
        few = inside.groupBy("v").count().limit(NARROW + 1).collect()
        if len(few) <= NARROW:
            for v, n in sorted(map(tuple, few)):
                below += n
                if rank < below:
                    return v
        last = (low, high)
        low, high, below = _narrowed(values, rank, low, high, below)
        if (low, high) == last:                         # two neighbours and nothing between
            mid = inside.filter(F.col("v") > low).agg(F.min("v")).first()[0]
            n = inside.filter(F.col("v") == low).count()
            if rank < below + n:
                return low
            low, below = mid, below + n
    return low


#: Size of the quantile sketches, and how far a sketched rank is off at most (99 % of sketches).
KLL_K = 2048


def kll_rank_error(k: int = KLL_K) -> float:
    """Normalised rank error of a KLL sketch of size ``k`` at 99 % confidence."""
    return 2.296 / k ** 0.9723


def _between(values: DataFrame, low: float, high: float, ranks: list[int]) -> list | None:
    """The values of some ranks, if [low, high] holds them in at most ``NARROW`` values: one
    pass, whose first group counts what is below."""
    below = F.when(F.col("v") >= low, F.col("v"))
    few = (values.filter(F.col("v") <= high).groupBy(below.alias("v")).count()
           .limit(NARROW + 2).collect())
    if len(few) > NARROW + 1:
        return None
    at, out = 0, []
    for v, n in sorted(few, key=lambda r: (r[0] is not None, r[0])):
        out += [v for r in ranks if at <= r < at + n]
        at += n
    return out if len(out) == len(ranks) and None not in out else None


def exact_percentile(df: DataFrame, column: str, q: float) -> float | None:
    """The interpolated percentile of the non-null values, as ``percentile`` gives it, with
    neither all values nor all distinct ones in one task.

    A KLL sketch bounds the interval that holds the one or two order statistics, and a second
    pass counts what is below it and the values inside; only where these are too many (or the
    sketch was off) is the interval narrowed further.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    e = kll_rank_error()
    n, sketched, low, high = (
        values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                   F.kll_sketch_agg_double("v", KLL_K).alias("s"))
        .select("n", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", F.array(
            F.lit(max(0.0, q - e)), F.lit(min(1.0, q + e))))), "lo", "hi").first())
    if not n:
        return None
    place = q * (n - 1)
    first = int(place)
    ranks = [first, first + 1] if place > first else [first]
    # at the ends the sketch is not asked
    low, high = (sketched[0] if q - e > 0 else low), (sketched[1] if q + e < 1 else high)
    found = _between(values, low, high, ranks) or [order_statistic(values, r) for r in ranks]
    return found[0] + (found[-1] - found[0]) * (place - first)


def system_health_full(null_status: DataFrame, log: DataFrame, drift: DataFrame,
                       collisions: DataFrame, as_of, approx_percentile: bool = False
                       ) -> DataFrame:
    """A5 + J4: completeness, quality, latency and drift in one row.

    Each side is reduced per table key before the joins, so no count is
    multiplied by another log's rows.  The latency percentile is exact, found
    by ``exact_percentile`` (a few small jobs when the plan is built);
    ``approx_percentile=True`` switches to a fixed-size sketch.
    """
    a = _ts(as_of)
    nvs = (null_status.filter(F.col("checked_at") > a - F.expr("INTERVAL 24 HOURS"))
           .withColumn("completion_percentage",
                       completion_pct(F.col("null_vectors"), F.col("total_rows"))))
    keys = nvs.select(*TABLE_KEY).distinct()
    vl = (log.filter(F.col("created_at") > a - F.expr("INTERVAL 24 HOURS"))
             .join(keys, TABLE_KEY, "left_semi"))
    sdl = drift.join(keys, TABLE_KEY, "left_semi")
    cl = (collisions.filter(F.col("occurred_at") > a - F.expr("INTERVAL 7 DAYS"))
                    .join(keys, TABLE_KEY, "left_semi"))
    ok = F.col("status") == "success"
    p95 = (F.percentile_approx(F.when(ok, F.col("processing_time")), 0.95, 10000)
           if approx_percentile else
           F.lit(exact_percentile(vl.filter(ok), "processing_time", 0.95)).cast("double"))
    s_nvs = nvs.agg(
        F.count(F.col("vector_column")).alias("vectors_populated"),
        F.count_if(F.col("null_vectors") > 0).alias("tables_with_nulls"),
        F.avg("completion_percentage").cast("double").alias("avg_completion_percentage"),
        F.max("checked_at").alias("last_null_check"))
    s_vl = vl.agg(
        F.count_distinct("embedding_model").alias("unique_models"),
        F.count_if(F.col("status") == "failed").alias("failed_vectorizations"),
        F.count_if(ok).alias("successful_vectorizations"),
        F.avg(F.when(ok, F.col("processing_time"))).alias("avg_processing_time_ms"),
        p95.alias("p95_processing_time_ms"),
        F.max("created_at").alias("last_vectorization"))
    s_sdl = sdl.agg(F.count_if(~F.col("resolved")).alias("unresolved_drift_issues"),
                    F.max("detected_at").alias("last_drift_detection"))
    s_cl = cl.agg(F.count_if(F.col("collision_severity") == "critical")
                  .alias("critical_collisions"))
    # four one-row partials stacked and folded into one row (no join needed)
    cols = ["vectors_populated", "tables_with_nulls", "avg_completion_percentage",
            "unique_models", "failed_vectorizations", "successful_vectorizations",
            "avg_processing_time_ms", "p95_processing_time_ms", "unresolved_drift_issues",
            "critical_collisions", "last_null_check", "last_vectorization",
            "last_drift_detection"]
    stacked = (s_nvs.unionByName(s_vl, allowMissingColumns=True)
               .unionByName(s_sdl, allowMissingColumns=True)
               .unionByName(s_cl, allowMissingColumns=True))
    return stacked.agg(*[F.max(c).alias(c) for c in cols])


# --- W1 / T2 / T3 --------------------------------------------------------------

def latest_status(null_status: DataFrame,
                  key: tuple[str, ...] = ("database_name", "schema_name", "table_name",
                                          "vector_column")) -> DataFrame:
    """Rows whose checked_at is the latest of their key (ties kept)."""
    w = Window.partitionBy(*key).orderBy(F.col("checked_at").desc())
    return (null_status.withColumn("_r", F.rank().over(w))
            .filter(F.col("_r") == 1).drop("_r"))


def completion_summary(null_status: DataFrame, as_of) -> DataFrame:
    """Latest check per target with health and freshness labels,
    worst first (completion asc, nulls desc)."""
    s = latest_status(null_status)
    pct = completion_pct(F.col("null_vectors"), F.col("total_rows"))
    return (s.select(*TABLE_KEY, "vector_column", "config_key", "null_vectors",
                     "total_rows", pct.alias("completion_percentage"),
                     "last_vectorized_at", "checked_at")
             .withColumn("health_status", health_status(F.col("completion_percentage")))
             .withColumn("freshness_status",
                         freshness_status(F.col("last_vectorized_at"), as_of))
             .orderBy(F.col("completion_percentage").asc(), F.col("null_vectors").desc()))


def recent_history(df: DataFrame, key: list[str], ts_col: str, n: int,
                   tiebreak: list[str] | None = None) -> DataFrame:
    """Newest ``n`` rows per key (``row_number``; Spark plans a
    WindowGroupLimit so each partition keeps only n rows per key before the
    shuffle)."""
    w = Window.partitionBy(*key).orderBy(F.col(ts_col).desc(),
                                         *[F.col(c) for c in (tiebreak or [])])
    return (df.withColumn("rn", F.row_number().over(w))
              .filter(F.col("rn") <= n))


# --- A6 / A11 / A12 ------------------------------------------------------------

def status_summary(log: DataFrame, by: list[str]) -> DataFrame:
    """Totals per status, success rate (0 when empty), number of distinct
    failure reasons (the reasons themselves: ``failure_reasons``, long form,
    so no group ever gathers a list)."""
    st = F.col("status")
    out = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(st == "success").alias("successful"),
        F.count_if(st == "failed").alias("failed"),
        F.count_if(st == "retry").alias("retried"),
        F.count_if(st == "skipped").alias("skipped"),
        F.count_distinct(F.when(st == "failed", F.col("error_message")))
         .alias("n_failure_reasons"))
    rate = F.coalesce(F.try_divide(F.col("successful").cast("double") * 100.0,
                                   F.col("total").cast("double")), F.lit(0.0))
    return out.withColumn("success_rate", F.round(rate, 6))


def failure_reasons(log: DataFrame, by: list[str]) -> DataFrame:
    """A6, the failure list: one row per (group, reason) with its count."""
    return (log.filter(F.col("status") == "failed")
               .groupBy(*by, F.coalesce(F.col("error_message"), F.lit("")).alias("reason"))
               .agg(F.count(F.lit(1)).alias("failures")))


def throughput(log: DataFrame, run_col: Column) -> DataFrame:
    """Processed rows per second of wall time and success % per run."""
    g = log.groupBy(run_col.alias("run")).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.min("created_at").alias("started_at"),
        F.max("created_at").alias("finished_at"))
    secs = (epoch_us(F.col("finished_at")) - epoch_us(F.col("started_at"))) / 1e6
    return g.select(
        "run", "processed", "successful",
        F.round(secs, 6).alias("elapsed_s"),
        F.round(F.when(secs > 0, F.col("processed") / secs), 6).alias("docs_per_s"),
        F.round(F.col("successful") * 100.0 / F.col("processed"), 6).alias("success_pct"))


def queue_depth(tasks: DataFrame) -> DataFrame:
    """Tasks per (status, priority)."""
    return tasks.groupBy("status", "priority").agg(F.count(F.lit(1)).alias("tasks"))


def migration_progress(df: DataFrame, new_vector_col: str, by: list[str] | None = None
                       ) -> DataFrame:
    """A10: rows migrated to the new vector column, total, status."""
    g = df.groupBy(*(by or [])).agg(F.count(new_vector_col).alias("rows_migrated"),
                                    F.count(F.lit(1)).alias("total_rows"))
    m, t = F.col("rows_migrated"), F.col("total_rows")
    return g.withColumn("status", F.when(m == 0, "pending").when(m < t, "in_progress")
                        .otherwise("completed"))
