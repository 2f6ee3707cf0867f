"""A1-A3 kept up to date from changes, without counting the tables again.

A store holds totals per group (``base``) and signed deltas per batch of changes
(``deltas/batch_id=<n>``).  A batch writes its deltas by overwriting its own folder, so a
replayed batch changes nothing; the current totals are the base and the sum of all deltas
after it.  ``fold`` makes a new base of a store; the batches in it are named there, and one
of them that is replayed later is not counted twice.

A change says of one row what it was and what it is: the group and whether its vector is
missing, before (null: the row was not there) and after (null: it is gone).  Changes come from
a comparison of two snapshots (J2) or from the newest event per row (W4).
"""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from .monitor import completion_pct


def row_changes(old: DataFrame, new: DataFrame, id_col: str, group_col: str,
                missing: Column) -> DataFrame:
    """The rows that differ between two tables in group or missing vector: old_group, old_null,
    new_group, new_null.  Only ids, groups and flags are joined."""
    def side(df, name):
        return df.select(F.col(id_col).alias("_id"), F.lit(True).alias(f"_{name}"),
                         F.col(group_col).alias(f"{name}_group"), missing.alias(f"{name}_null"))

    j = side(old, "old").join(side(new, "new"), "_id", "full_outer")
    same = (F.col("old_group").eqNullSafe(F.col("new_group"))
            & F.col("old_null").eqNullSafe(F.col("new_null"))
            & F.col("_old").eqNullSafe(F.col("_new")))
    return j.filter(~same).select("old_group", "old_null", "new_group", "new_null",
                                  F.col("_old").isNotNull().alias("was"),
                                  F.col("_new").isNotNull().alias("is"))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed counts per group: group, null_vectors, total_rows."""
    def part(there, group, null, sign):
        return F.when(there, F.struct(F.col(group).alias("group"),
                                      F.when(F.col(null), sign).otherwise(0).alias("null_vectors"),
                                      F.lit(sign).alias("total_rows")))

    moved = F.array_compact(F.array(part(F.col("was"), "old_group", "old_null", -1),
                                    part(F.col("is"), "new_group", "new_null", 1)))
    return (changes.select(F.inline(moved)).groupBy("group")
            .agg(F.sum("null_vectors").alias("null_vectors"),
                 F.sum("total_rows").alias("total_rows")))


class Totals:
    """The store at ``path``, for groups of one type."""

    def __init__(self, spark: SparkSession, path: str, group_type: DataType):
        self.spark, self.path = spark, path
        self.schema = StructType([StructField("group", group_type),
                                  StructField("null_vectors", LongType()),
                                  StructField("total_rows", LongType())])

    def _there(self, *parts: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
            os.path.join(self.path, *parts))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _shaped(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name)
                           for f in self.schema.fields])

    def start(self, counts: DataFrame) -> None:
        """A new store from one full count (group, null_vectors, total_rows)."""
        self._shaped(counts).write.mode("errorifexists").parquet(os.path.join(self.path, "base"))

    def apply(self, batch_id: int, changes: DataFrame) -> None:
        """The changes of a batch; the same batch again replaces what it wrote.  A batch that a
        base was folded from has been counted."""
        if batch_id not in self._folded():
            self._shaped(deltas(changes)).write.mode("overwrite").parquet(
                os.path.join(self.path, "deltas", f"batch_id={batch_id}"))

    def _folded(self) -> set[int]:
        """The batches in the base: one row each."""
        if not self._there("folded"):
            return set()
        return {r[0] for r in self.spark.read.parquet(os.path.join(self.path, "folded")).collect()}

    def current(self) -> DataFrame:
        """group, null_vectors, total_rows, completion_percentage; groups without rows go."""
        every = self.spark.read.schema(self.schema).parquet(os.path.join(self.path, "base"))
        if self._there("deltas"):
            every = every.unionByName(self.spark.read.schema(self.schema).parquet(
                os.path.join(self.path, "deltas")).select(*self.schema.names))
        now = every.groupBy("group").agg(F.sum("null_vectors").alias("null_vectors"),
                                         F.sum("total_rows").alias("total_rows"))
        return now.filter("total_rows <> 0").withColumn(
            "completion_percentage", completion_pct(F.col("null_vectors"), F.col("total_rows")))

    def fold(self, path: str) -> "Totals":
        """A new store whose base is the current totals; this one stays as it is."""
        out = Totals(self.spark, path, self.schema["group"].dataType)
        done = self._folded()
        if self._there("deltas"):
            ids = self.spark.read.option("basePath", os.path.join(self.path, "deltas")).parquet(
                os.path.join(self.path, "deltas")).select("batch_id").distinct()
            done |= {r[0] for r in ids.collect()}
            # a batch without changes has no row but a folder
            done |= self._batches()
        self.spark.createDataFrame([(i,) for i in sorted(done)], "batch_id long").coalesce(
            1).write.mode("errorifexists").parquet(os.path.join(path, "folded"))
        out.start(self.current())
        return out

    def _batches(self) -> set[int]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
            os.path.join(self.path, "deltas"))
        own = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
        return {int(s.getPath().getName().split("=")[1]) for s in own
                if s.getPath().getName().startswith("batch_id=")}
