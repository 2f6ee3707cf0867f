"""J2 by digest tree: two stored snapshots are compared bucket by bucket.

A snapshot is written with a tree over its rows.  A row's id names one of ``fan_out ** depth``
leaf buckets; the digest of a bucket does not depend on the order of its rows (number of rows,
sum of one hash and exclusive-or of another, both over id and text), and the digest of a node
is folded from those of its ``fan_out`` children.  Two trees are walked from the root, and
below a node whose digests agree nothing is looked at.  What is left are the buckets that
differ; only their rows are read and joined.  Buckets that agree hold unchanged rows, listed,
if wanted, from the narrow columns of one snapshot.

Rows are stored in folders (the nodes of the second level) and in order of their bucket, so
the folders prune the scan and the order lets Parquet's own bounds skip the rest.

Defined results: rows without an id are not part of a snapshot; ids are unique in it; a null
text differs from an empty one.

Bounds: at most ``fan_out ** depth`` bucket numbers reach the driver, and only those that
differ.  Buckets whose rows differ but whose count, 64-bit sum and 64-bit exclusive-or agree
would be missed; the chance is about 2 ** -128 for each changed bucket.
"""
from __future__ import annotations

import dataclasses
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .detect import snapshot_diff

FAN_OUT, DEPTH = 16, 4
#: Bucket numbers written into a filter; more are joined.
LISTED = 512


def _digests(id_col: str, text_col: str) -> list[Column]:
    none = F.col(text_col).isNull()
    return [F.xxhash64(id_col, text_col, none).alias("h"),
            F.xxhash64(F.lit("second"), none, text_col, id_col).alias("g")]


def _folded(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"),
                                 F.bit_xor("mixed").alias("mixed"))


def write_snapshot(df: DataFrame, id_col: str, text_col: str, path: str,
                   fan_out: int = FAN_OUT, depth: int = DEPTH) -> "Snapshot":
    """Write ``df`` (id and text) and its tree to the new folder ``path``."""
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64("id"), F.lit(fan_out ** depth)).cast("int")
    rows = (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .filter(F.col("id").isNotNull())
            .select("id", "text", F.length("text").alias("n_chars"), *_digests("id", "text"),
                    bucket.alias("bucket")))
    folder = F.floor(F.col("bucket") / fan_out ** max(0, depth - 2)).cast("int")
    (rows.withColumn("folder", folder).repartitionByRange("bucket")
     .sortWithinPartitions("folder", "bucket").write.partitionBy("folder")
     .parquet(f"{path}/rows"))
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    level = (stored.groupBy("bucket")
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(20,0)"))
                  .alias("total"), F.bit_xor("g").alias("mixed"))
             .withColumnRenamed("bucket", "node")
             .withColumn("total", F.col("total").cast("decimal(38,0)")))
    for d in range(depth, -1, -1):
        # decided by the number of nodes, at most fan_out ** d
        level.coalesce(max(1, fan_out ** d // 100_000)).write.parquet(f"{path}/tree/level={d}")
        level = spark.read.parquet(f"{path}/tree/level={d}")
        level = _folded(level.withColumn("node", F.floor(F.col("node") / fan_out).cast("int")),
                        "node").withColumn("total", F.col("total").cast("decimal(38,0)"))
    kind = StructType([*stored.schema.fields, StructField("folder", IntegerType())]).json()
    (spark.createDataFrame([(fan_out, depth, kind)], "fan_out int, depth int, kind string")
     .coalesce(1).write.parquet(f"{path}/shape"))
    return Snapshot(spark, path)


@dataclasses.dataclass
class Snapshot:
    """A written snapshot: its rows by bucket, and its tree by level."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        self.fan_out, self.depth, kind = self.spark.read.parquet(f"{self.path}/shape").first()
        self.schema = StructType.fromJson(json.loads(kind))

    def level(self, d: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tree/level={d}")

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets: only their folders are opened."""
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        if buckets is None:
            return rows
        wide = self.fan_out ** max(0, self.depth - 2)
        rows = rows.filter(F.col("folder").isin(sorted({b // wide for b in buckets})))
        return _with(rows, "bucket", buckets)


def _with(df: DataFrame, column: str, numbers: list[int]) -> DataFrame:
    """Rows whose ``column`` is one of ``numbers`` (at most one for each leaf of a tree)."""
    if len(numbers) <= LISTED:
        return df.filter(F.col(column).isin(numbers))
    wanted = df.sparkSession.createDataFrame([(n,) for n in numbers], f"{column} int")
    return (df.filter(F.col(column).between(min(numbers), max(numbers)))
            .join(F.broadcast(wanted), column, "left_semi"))


def unequal_buckets(old: Snapshot, new: Snapshot) -> list[int]:
    """The leaf buckets whose digests differ, found from the root down."""
    if (old.fan_out, old.depth) != (new.fan_out, new.depth):
        raise ValueError("the snapshots' trees have different shapes")
    nodes = [0]
    for d in range(old.depth + 1):
        if d:
            nodes = [n * old.fan_out + i for n in nodes for i in range(old.fan_out)]
        a, b = (_with(s.level(d), "node", nodes) for s in (old, new))
        b = b.select("node", *[F.col(c).alias(f"new_{c}") for c in ("n", "total", "mixed")])
        same = F.lit(True)
        for c in ("n", "total", "mixed"):
            same = same & F.col(c).eqNullSafe(F.col(f"new_{c}"))
        nodes = sorted(r[0] for r in a.join(b, "node", "full_outer").filter(~same)
                       .select("node").collect())
        if not nodes:
            break
    return nodes


def snapshot_changes(old: Snapshot, new: Snapshot, id_col: str = "id",
                     unchanged: bool = False) -> DataFrame:
    """``detect.snapshot_diff`` of two stored snapshots: id, operation, old_text, new_text,
    old_len, new_len, from the buckets that differ.  With ``unchanged`` the rows of the others
    follow, their lengths from the new snapshot and their texts left out."""
    buckets = unequal_buckets(old, new)
    diff = snapshot_diff(old.rows(buckets).select("id", "text"),
                         new.rows(buckets).select("id", "text"), "id", "text")
    diff = diff.withColumns({"old_len": F.length("old_text"), "new_len": F.length("new_text")})
    if not unchanged:
        return diff.filter("operation <> 'UNCHANGED'").withColumnRenamed("id", id_col)
    rest = new.rows()
    if len(buckets) > LISTED:
        seen = new.spark.createDataFrame([(b,) for b in buckets], "bucket int")
        rest = rest.join(F.broadcast(seen), "bucket", "left_anti")   # one row a leaf at most
    else:
        rest = rest.filter(~F.col("bucket").isin(buckets))
    rest = rest.select("id", F.lit("UNCHANGED").alias("operation"),
                       F.lit(None).cast("string").alias("old_text"),
                       F.lit(None).cast("string").alias("new_text"),
                       F.col("n_chars").alias("old_len"), F.col("n_chars").alias("new_len"))
    return diff.unionByName(rest).withColumnRenamed("id", id_col)
