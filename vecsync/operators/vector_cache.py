"""UD1/P2 with a content-addressed cache: no text is sent twice for a model and width.

An entry is filed under the SHA-256 of model, width and cleaned text, in one of ``parts``
folders (``part=<n>``) of Parquet files.  Every folder has one Bloom filter: ``HASHES`` bits of
its ``bits`` are set for each entry, stored as 64-bit words (part, word, set).  A lookup asks
the filters first, in a join of narrow rows; only folders that may hold one of the wanted
digests are opened, and only digests that may be there are joined with vectors.  A filter never
loses an entry; with n entries in a part it lets a stranger pass with a probability of
``false_positive_rate(n, bits)``, 0.65 % at 12 bits an entry.

``embed_cached`` sends each distinct text once that the cache does not hold, writes what came
back as a new generation (vectors and filter words) before anything reads it, and gives every
row its vector.  Refusals are rows and are not cached.

Bounds: the numbers of the folders to open reach the driver (at most ``parts``).
"""
from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .embed import embed_outcomes

HASHES = 4


def false_positive_rate(entries: float, bits: int) -> float:
    """Of a filter of ``bits`` bits that holds ``entries``."""
    return (1 - math.exp(-HASHES * entries / bits)) ** HASHES


def digest_of(text: Column, model: str, dimension: int) -> Column:
    """What an entry is filed under; null for a null text."""
    return F.unhex(F.sha2(F.concat(F.lit(f"{model}\x00{dimension}\x00"), text), 256))


class VectorCache:
    """The cache in the shared folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.parts, self.bits = spark.read.parquet(f"{path}/shape").first()

    @classmethod
    def create(cls, spark: SparkSession, path: str, parts: int = 256,
               bits: int = 1 << 20) -> "VectorCache":
        """A new cache; ``bits`` of a part's filter, for bits / 12 entries at the stated rate."""
        spark.createDataFrame([(parts, bits)], "parts int, bits int").coalesce(1).write.mode(
            "errorifexists").parquet(f"{path}/shape")
        out = cls(spark, path)
        out.add(spark.createDataFrame([], "digest binary, vector array<float>"))
        return out

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.parts)).cast("int")

    def _bits(self, df: DataFrame, *keep: str) -> DataFrame:
        """One row for each bit of a digest: part, word, bit (a mask), and ``keep``."""
        at = F.explode(F.array(*[F.pmod(F.xxhash64("digest", F.lit(i + 1)), F.lit(self.bits))
                                 for i in range(HASHES)]))
        return df.select(self._part().alias("part"), *keep, at.alias("at")).select(
            "part", *keep, F.floor(F.col("at") / 64).cast("int").alias("word"),
            F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("bit"))

    def entries(self) -> DataFrame:
        return (self.spark.read.option("recursiveFileLookup", "false")
                .schema("digest binary, vector array<float>, gen string, part int")
                .parquet(f"{self.path}/vectors"))

    def filters(self) -> DataFrame:
        words = self.spark.read.schema("part int, word int, set long, gen string").parquet(
            f"{self.path}/filters")
        return words.groupBy("part", "word").agg(F.bit_or("set").alias("set"))

    def add(self, vectors: DataFrame) -> None:
        """Entries (digest, vector) as a new generation.  Its filter is written last and made
        from what was written, so an unfinished generation is only ever missed."""
        gen = uuid.uuid4().hex[:12]
        place = f"{self.path}/vectors/gen={gen}"
        (vectors.select("digest", "vector", self._part().alias("part"))
         .repartition("part").write.partitionBy("part").parquet(place))
        mine = self.spark.read.schema("digest binary, vector array<float>, part int").parquet(place)
        words = self._bits(mine.select("digest")).groupBy("part", "word").agg(
            F.bit_or("bit").alias("set"))
        words.write.parquet(f"{self.path}/filters/gen={gen}")

    def maybe(self, wanted: DataFrame) -> DataFrame:
        """Of the distinct digests ``wanted`` those that the filters let pass: part, digest."""
        asked = self._bits(wanted.select("digest"), "digest")
        return (asked.join(self.filters(), ["part", "word"])
                .filter(F.col("set").bitwiseAND(F.col("bit")) != 0)
                .groupBy("part", "digest").agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") == HASHES).select("part", "digest"))

    def lookup(self, wanted: DataFrame, scratch: str) -> DataFrame:
        """digest, vector of the distinct digests ``wanted`` that are here; ``scratch`` is a new
        shared folder for the digests that passed the filters."""
        self.maybe(wanted).write.parquet(scratch)
        passed = self.spark.read.schema("part int, digest binary").parquet(scratch)
        # one number a folder
        parts = sorted(r[0] for r in passed.select("part").distinct().collect())
        found = (self.entries().filter(F.col("part").isin(parts))
                 .join(passed.select("digest"), "digest"))
        # an entry that two runs added at once is there twice, alike
        return found.groupBy("digest").agg(F.first("vector").alias("vector"))


def embed_cached(df: DataFrame, id_col: str, text_col: str, cache: VectorCache, scratch: str,
                 model: str, dimension: int, provider: str = "mock", **config) -> DataFrame:
    """id, vector, outcome ('hit', 'success', 'retry', 'dead', 'skipped' for a null text),
    message and sent (requests with the row's text) of every row of ``df``; ``scratch`` is a new
    shared folder for this run's steps."""
    spark = cache.spark

    def written(step: DataFrame, name: str) -> DataFrame:
        step.write.parquet(f"{scratch}/{name}")
        return spark.read.schema(step.schema).parquet(f"{scratch}/{name}")

    # with the texts: ``df`` may clean them, which takes longer than reading them back
    rows = written(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                   .withColumn("digest", digest_of(F.col("text"), model, dimension)), "rows")
    wanted = rows.select("digest").filter(F.col("digest").isNotNull()).distinct()
    hits = written(cache.lookup(wanted, f"{scratch}/passed"), "hits")
    missing = written(wanted.join(hits, "digest", "left_anti"), "missing")
    texts = (rows.select("digest", "text").join(missing, "digest", "left_semi")
             .groupBy("digest").agg(F.first("text").alias("text")))
    # the provider is called in this step and nowhere else
    tried = written(embed_outcomes(texts, "text", provider, dimension=dimension, model=model,
                                   **config).drop("text"), "tried")
    cache.add(tried.filter("outcome = 'success'"))
    known = tried.unionByName(hits.select(
        "digest", "vector", F.lit("hit").alias("outcome"),
        F.lit(None).cast("string").alias("message"), F.lit(0).alias("sent")))
    return rows.drop("text").join(known, "digest", "left").select(
        F.col("id").alias(id_col), "vector", F.coalesce("outcome", F.lit("skipped"))
        .alias("outcome"), "message", F.coalesce("sent", F.lit(0)).alias("sent"))
