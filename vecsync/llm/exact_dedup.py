"""Exact deduplication: tree-merge of sorted digest runs, DataFrame operations only.

Every row falls into one of ``fan_in ** rounds`` leaf runs by a hash of its identifier.  A
run is sorted by digest and identifier and reduced to one entry per text: the first of its
stretch, and how many rows there are.  In each binomial round, ``fan_in`` runs meet in the
run of the lowest number among them, digest range by digest range; their entries are merged
in order, and the first of equal ones stays, until one run per range is left.  Every level
is written once, in order.  The winners then go down the same tree to the leaf runs and from
there to the rows, so each level is read once on the way up and once on the way down.  A
text that a third of all rows share is one entry per run at every level, so no task ever
meets all its copies.

An entry is verified at every level: entries merge only when the SHA-256, the MD5 and the
byte length of the normalised text all agree.

Defined results
    null text                counts as the empty text
    empty table              empty result
    null identifiers         never win against others; alone, the kept identifier is null
    equal identifiers        with different texts: separate texts; with equal texts: the
                             rows share the decision (``deduplicate`` returns the one whose
                             columns have the least hash)
    extra columns            kept by ``deduplicate``, whatever their names
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsync.llm.common import (ascii_lower, col, id_keys, materialise, one_of_each, packed,
                                shuffle_partitions, unpacked)

KEY = ["sha", "md", "len"]
RANGES = 4096


def _digests(text) -> list:
    norm = ascii_lower(text)
    return [F.unhex(F.sha2(norm, 256)).alias("sha"), F.unhex(F.md5(norm)).alias("md"),
            F.octet_length(norm).alias("len")]


def _merge(runs: DataFrame, keep: str, partitions: int) -> DataFrame:
    """Entries (range, run, digests, id, n) that meet in their run, range by range: sorted, the
    first of each stretch of equal digests stays, with the sum of n.  ``first`` of a struct
    depends on the order, so the sort stays in the plan and the aggregation runs along it."""
    order = F.col("id").asc_nulls_last() if keep == "min" else F.col("id").desc_nulls_last()
    met = (runs.repartition(partitions, "range", "run")
           .sortWithinPartitions("range", "run", *KEY, order))
    return (met.groupBy("range", "run", *KEY)
            .agg(F.first(F.struct("id")).alias("best"), F.sum("n").alias("n"))
            .select("range", "run", *KEY, F.col("best.id").alias("id"), "n"))


def digest_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  keep: str = "min", fan_in: int = 8) -> tuple[DataFrame, list[DataFrame]]:
    """Rows as (id, digests, run) and the merged runs of every level, leaves first, written."""
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rounds = max(2, math.ceil(math.log(max(parts, 2), fan_in)))
    rows = (docs.select(col(id_col).alias("id"), *_digests(col(text_col)))
            .withColumn("run", F.pmod(F.xxhash64("id", "md"), F.lit(fan_in ** rounds)))
            .withColumn("range", F.pmod(F.xxhash64("sha"), F.lit(RANGES))))
    rows = materialise(rows, "dedup-rows")
    levels = [materialise(_merge(rows.withColumn("n", F.lit(1)), keep, parts), "dedup-runs")]
    for _ in range(rounds):
        parents = levels[-1].withColumn("run", F.floor(F.col("run") / fan_in))
        levels.append(materialise(_merge(parents, keep, parts), "dedup-runs"))
    return rows, levels


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "min", fan_in: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, levels = digest_groups(docs, id_col, text_col, keep, fan_in)
    won = levels[-1].withColumnRenamed("id", "keep_id").withColumnRenamed("n", "size")
    for lower in reversed(levels[:-1]):
        below = lower.select("range", F.col("run").alias("child"),
                             F.floor(F.col("run") / fan_in).alias("run"), *KEY)
        won = (below.join(won, ["range", "run", *KEY])
               .select("range", F.col("child").alias("run"), *KEY, "keep_id", "size"))
    return (rows.join(won, ["range", "run", *KEY])
            .select(F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"),
                    F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "min", fan_in: int = 8) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text, with their own columns."""
    _, levels = digest_groups(docs, id_col, text_col, keep, fan_in)
    own = [*KEY, "id_none", "id_text"]
    won = levels[-1].select(*KEY, *id_keys("id"))
    rows = docs.select(packed(docs), *_digests(col(text_col)), *id_keys(id_col))
    kept = rows.join(won, own, "left_semi")
    return unpacked(one_of_each(kept, own), docs.columns)


ORACLE = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
