"""Table scans.

``scan_text_table`` is the user-table scan (id + text, pruned to the two
columns so the Parquet reader only decodes those); ``scan_multi_target``
turns several text columns into long form with ``unpivot`` (one row per
(id, target column)), so one job serves every target of a table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events "
          "documents embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_text_table(df: DataFrame, id_column: str, text_column: str,
                    extra: tuple[str, ...] = ()) -> DataFrame:
    """The (id, text) projection of a configured table."""
    return df.select(F.col(id_column).alias("row_id"),
                     F.col(text_column).alias("text"), *extra)


def scan_multi_target(df: DataFrame, id_columns: list[str],
                      text_columns: list[str]) -> DataFrame:
    """One row per (id, text column) for a table with several targets."""
    return (df.select(*id_columns, *[F.col(c).cast("string") for c in text_columns])
              .unpivot(id_columns, text_columns, "text_column", "text"))


def read_jdbc_table(spark: SparkSession, url: str, table: str, id_column: str,
                    lower: int, upper: int, partitions: int, properties: dict | None = None,
                    columns: list[str] | None = None) -> DataFrame:
    """S1 over a database: a partitioned JDBC scan (``partitions`` parallel
    range queries on ``id_column``), pruned to ``columns``.  Needs the JDBC
    driver jar on the classpath."""
    df = spark.read.jdbc(url, table, column=id_column, lowerBound=lower, upperBound=upper,
                         numPartitions=partitions, properties=properties or {})
    return df.select(*columns) if columns else df
