"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is one aggregation (combined before the shuffle) and one join that adaptive
execution can split, so a node with very many neighbours is never gathered into a task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsync.llm.common import materialise


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("m").alias("u"), "v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("v").agg(F.min("u").alias("m"))
    far = e.join(low, "v").filter("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return far.unionByName(low.select(F.col("m").alias("u"), "v")).distinct()


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node reachable.

    ``edges`` has columns u and v of one orderable type; loops, repeats and either order are
    fine; no edges give no rows.  Ends when a round leaves the edges as they are.
    """
    e = materialise(edges.filter("u <> v")
                    .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                    .distinct(), "components")
    mark = _mark(e)
    while mark[0]:
        e = materialise(_small_star(_large_star(e)), "components")
        last, mark = mark, _mark(e)
        if mark == last:
            break
    roots = e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)
