"""Change detection and selection: J2, P1–P3, P5–P7, P9, W3, W4.

The reference learns about changes from a row trigger; here a change is
either an event of the feed (P1) or the difference of two snapshots (J2).
"""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import basic_clean
from ..functions.time import epoch_us


def _ts(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("timestamp_ntz")


def snapshot_diff(old: DataFrame, new: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Full outer join of two snapshots on the id; each id is classified
    INSERT / UPDATE (text IS DISTINCT FROM) / UNCHANGED / DELETE.

    Both inputs are shuffled once on the id (or not at all when they are
    bucketed on it).  Only id + text are read.
    """
    o = old.select(F.col(id_col).alias("_id"), F.col(text_col).alias("old_text"))
    n = new.select(F.col(id_col).alias("_id"), F.col(text_col).alias("new_text"),
                   F.lit(True).alias("_in_new"))
    o = o.withColumn("_in_old", F.lit(True))
    j = o.join(n, "_id", "full_outer")
    op = (F.when(F.col("_in_old").isNull(), "INSERT")
           .when(F.col("_in_new").isNull(), "DELETE")
           .when(~F.col("old_text").eqNullSafe(F.col("new_text")), "UPDATE")
           .otherwise("UNCHANGED"))
    return j.select(F.col("_id").alias(id_col), op.alias("operation"), "old_text", "new_text")


def snapshot_diff_narrow(old: DataFrame, new: DataFrame, id_col: str, text_col: str,
                         texts: bool = False) -> DataFrame:
    """J2 without texts in the join: id, operation, old_len, new_len from ids, 128-bit digests
    and lengths.  With ``texts``, ``new_text`` of the INSERT and UPDATE rows, looked up for
    those ids only (AQE sends few of them to the texts rather than all texts to them)."""
    def side(df, name):
        return df.select(F.col(id_col).alias("_id"), F.lit(True).alias(f"_in_{name}"),
                         F.unhex(F.md5(F.col(text_col))).alias(f"_{name}"),
                         F.length(text_col).alias(f"{name}_len"))

    same = F.col("_old").eqNullSafe(F.col("_new")) & F.col("old_len").eqNullSafe(F.col("new_len"))
    op = (F.when(F.col("_in_old").isNull(), "INSERT").when(F.col("_in_new").isNull(), "DELETE")
           .when(same, "UNCHANGED").otherwise("UPDATE"))
    diff = (side(old, "old").join(side(new, "new"), "_id", "full_outer")
            .select(F.col("_id").alias(id_col), op.alias("operation"), "old_len", "new_len"))
    if not texts:
        return diff
    text = new.select(F.col(id_col), F.col(text_col).alias("new_text"))
    changed = diff.filter(F.col("operation").isin("INSERT", "UPDATE"))
    return (changed.join(text, id_col, "left")
            .unionByName(diff.filter(~F.col("operation").isin("INSERT", "UPDATE")),
                         allowMissingColumns=True))


def needs_vectorization(operation: Column, new_vector: Column, old_text: Column,
                        new_text: Column) -> Column:
    """INSERT with a NULL vector, or UPDATE whose text changed (Q5)."""
    return (((operation == "INSERT") & new_vector.isNull())
            | ((operation == "UPDATE") & ~old_text.eqNullSafe(new_text)))


def backfill_set(user: DataFrame, vector_col: str, priority: str = "low") -> DataFrame:
    """Rows whose vector is NULL, tagged with the backfill priority."""
    return user.filter(F.col(vector_col).isNull()).withColumn("priority", F.lit(priority))


def blank_status(raw: Column, cleaned: Column) -> Column:
    """P3: 'skipped' when the text is blank before or after cleaning."""
    blank_raw = basic_clean(raw) == ""
    return F.when(blank_raw | (cleaned == ""), "skipped").otherwise("embed")


def input_quality(text: Column) -> Column:
    """P9: 'null_text' | 'blank' | 'ok' (the type itself is enforced by the schema)."""
    return (F.when(text.isNull(), "null_text")
             .when(basic_clean(text) == "", "blank").otherwise("ok"))


def apply_conditions(df: DataFrame, conditions: list[str]) -> DataFrame:
    """P5: user SQL conditions ANDed; one Filter that Catalyst pushes to the scan."""
    if not conditions:
        return df
    return df.filter(functools.reduce(lambda a, b: a & b, [F.expr(c) for c in conditions]))


def outdated_model(user: DataFrame, vector_col: str, model_col: str, current_model: str
                   ) -> DataFrame:
    """Rows with a vector made by another model than the current one."""
    return user.filter(F.col(vector_col).isNotNull()
                       & ~F.col(model_col).eqNullSafe(F.lit(current_model)))


def look_back(df: DataFrame, ts_col: str, as_of, interval: str) -> DataFrame:
    """``ts > as_of - INTERVAL`` (a plain range predicate: pushed to Parquet)."""
    return df.filter(F.col(ts_col) > _ts(as_of) - F.expr(f"INTERVAL {interval}"))


def in_buckets(df: DataFrame, win: int, size: int) -> DataFrame:
    """Rows with a time ``_us`` by time bucket ``_b``; those of a bucket's last ``win``
    also in the next bucket, there as context (``_own`` is false).  A row without a time
    is its own and has no bucket."""
    own = F.floor(F.col("_us") / F.lit(size))
    near_end = F.col("_us") > (own + 1) * F.lit(size) - F.lit(win)
    return (df.select("*", F.posexplode(F.when(near_end, F.array(own, own + 1))
                                         .otherwise(F.array(own))).alias("_own", "_b"))
              .withColumn("_own", F.col("_own") == 0))


def debounce(df: DataFrame, key: list[str], ts_col: str, window_seconds: float,
             bucket_seconds: int = 3600) -> DataFrame:
    """Drop an event when the previous event of the same key is less than
    ``window_seconds`` older (compared with the previous event, kept or not).
    An event without a time stays.

    Hot keys are split by time: rows are windowed per (key, time bucket), so
    one key holding a third of the feed still spreads over many tasks.  The
    rows of a bucket's last ``window_seconds`` also go to the next bucket, as
    context only: whatever is farther back is outside the window anyway.  One
    scan, one shuffle, no join.  Exact for any window; ``bucket_seconds`` (at
    least the window) only sets the parallelism.
    """
    win = int(round(window_seconds * 1_000_000))
    size = max(int(bucket_seconds * 1_000_000), win, 1)
    x = in_buckets(df.withColumn("_us", epoch_us(F.col(ts_col))), win, size)
    w = Window.partitionBy(*key, "_b").orderBy("_us")
    gap = F.col("_us") - F.lag("_us").over(w)
    return (x.withColumn("_gap", gap)
             .filter(F.col("_own") & (F.col("_gap").isNull() | (F.col("_gap") >= win)))
             .drop("_gap", "_b", "_us", "_own"))


def latest_per_key(df: DataFrame, key: list[str], ts_col: str,
                   tiebreak: list[str] | None = None) -> DataFrame:
    """The last event per key wins (``row_number() = 1``; planned with a
    WindowGroupLimit so each map task keeps one row per key before the shuffle)."""
    w = Window.partitionBy(*key).orderBy(F.col(ts_col).desc(),
                                         *[F.col(c).desc() for c in tiebreak or []])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
