"""Lempel-Ziv phrase fingerprints: similarity as a compressor sees it, from small signatures.

A text's bytes are parsed once from left to right into dictionary phrases (LZ78: the longest
phrase known plus one byte becomes the next phrase).  The fingerprint is the ``SIZE`` least
hashes of the phrase set, in ascending order; the likeness of two texts is the Jaccard
likeness of their phrase sets, estimated from the least hashes of both (exact while both
sets fit).

``edited_neighbours`` pairs each document with the next one by ascending identifier without a
global window: ranges of the sort key, whose bounds come from a bounded sample, are shuffled
once; the first row of each range is sent to the range before it as well.  Rows of a range
stream past in order, so a task holds two documents and its current batch.

Defined results
    null and empty text      no phrase: empty fingerprint; two empty ones are alike (1), an
                             empty and another one are not (0)
    null identifiers         first in order; equal ones follow a hash of their text
    repeated rows            each is a document
    one document             is its own next one
    very long texts          whole
    empty table              empty result
    extra columns            ignored, whatever their names
"""
from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsync.llm.common import col, shuffle_partitions, slices
from vecsync.operators.embed import MAX_BUCKETS, bucket_of, key_bounds

SIZE, DIGITS = 128, 12
MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15


class Phrases:
    """The phrases of what was read so far: children by (phrase, byte), a hash each."""

    __slots__ = ("child", "hashes", "at")

    def __init__(self):
        self.child, self.hashes, self.at = {}, array("Q", [0]), 0

    def copy(self) -> "Phrases":
        other = Phrases.__new__(Phrases)
        other.child, other.hashes, other.at = self.child.copy(), self.hashes[:], self.at
        return other

    def read(self, data: bytes) -> "Phrases":
        child, hashes, at = self.child, self.hashes, self.at
        known = child.get
        for byte in data:
            key = at << 8 | byte
            to = known(key)
            if to is None:
                child[key] = len(hashes)
                hashes.append((hashes[at] * STEP + byte + 1) & MASK)
                at = 0
            else:
                at = to
        self.at = at
        return self

    def signature(self, size: int = SIZE) -> np.ndarray:
        """The least ``size`` hashes of the phrases, mixed and cut to 4 bits a digit."""
        x = np.frombuffer(self.hashes, dtype=np.uint64)[1:].copy()
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(33)
        x >>= np.uint64(64 - 4 * DIGITS)
        if len(x) > 2 * size:
            least = np.unique(np.partition(x, 2 * size - 1)[:2 * size])
            if len(least) >= size:
                return least[:size]
        return np.unique(x)[:size]


def text_of(signature: np.ndarray) -> str:
    """``DIGITS`` hexadecimal digits for each hash."""
    whole = signature.astype(">u8").tobytes().hex()
    return "".join(whole[at + 16 - DIGITS:at + 16] for at in range(0, len(whole), 16))


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Jaccard likeness of two phrase sets from their least hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    again = both[1:] == both[:-1]
    place = 1 + np.cumsum(~again)                       # among the distinct, of both[1:]
    return float((again & (place <= size)).sum() / min(size, int(place[-1])))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row, in one pass."""
    kind = docs.select(col(id_col)).schema[0].dataType
    src = docs.select(col(id_col).cast("string").alias("doc_id"),   # whole numbers stay whole
                      col(text_col).cast("string").alias("text"))

    def run(batches):
        for pdf in slices(batches, "text"):
            data = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fingerprint": [
                text_of(Phrases().read(t).signature()) for t in data]})

    return (src.mapInPandas(run, "doc_id string, fingerprint string")
            .withColumn("doc_id", F.col("doc_id").cast(kind)))


def _ranges(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with range and later; the first row of each range once more,
    as the last of the range before it (the first range's follows the last one)."""
    keys = ["doc_id", "digest"]
    x = docs.withColumn("digest", F.xxhash64("text"))
    parts = shuffle_partitions(docs.sparkSession)
    x = x.withColumn("range", bucket_of(x, keys, key_bounds(x, keys, min(MAX_BUCKETS, 4 * parts))))
    # one row a range: the driver sees at most MAX_BUCKETS of them
    first = x.groupBy("range").agg(F.min(F.struct(*keys)).alias("k")).orderBy("range").collect()
    x = x.withColumn("later", F.lit(False))
    if not first:
        return x
    before = docs.sparkSession.createDataFrame(
        [(r["k"][0], r["k"][1], first[i - 1]["range"]) for i, r in enumerate(first)],
        x.select("doc_id", "digest", F.col("range").alias("to")).schema)
    copies = (x.join(F.broadcast(before), x["doc_id"].eqNullSafe(before["doc_id"])
                     & (x["digest"] == before["digest"]))
              .select(x["doc_id"], x["text"], x["digest"], F.col("to").alias("range"),
                      F.lit(True).alias("later")))
    return x.unionByName(copies)


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
                      ) -> DataFrame:
    """Every document, the same with its last quarter replaced by the head of the next one,
    and how alike the fingerprints of both, and of the next document, are to its own."""
    kind = docs.select(col(id_col)).schema[0].dataType
    src = docs.select(col(id_col).alias("doc_id"),
                      F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    order = ["range", "later", "doc_id", "digest"]
    src = _ranges(src).repartition("range").sortWithinPartitions(*order)

    def run(batches):
        was = None              # the row before: range, id, kept part, state there, signature
        for pdf in slices(batches, "text"):
            out = []
            for at, later, doc, text in zip(pdf["range"], pdf["later"], pdf["doc_id"],
                                            pdf["text"]):
                cut = len(text) // 4
                keep = text[:len(text) - cut]
                state = Phrases().read(keep.encode("utf-8", "surrogatepass"))
                whole = state.copy().read(text[len(keep):].encode("utf-8", "surrogatepass"))
                sign = whole.signature()
                if was is not None and was[0] == at:
                    _, old, before, kept, size, own = was
                    head = text[:size].encode("utf-8", "surrogatepass")
                    edited = kept.read(head).signature()
                    digest = hashlib.sha256(before.encode("utf-8", "surrogatepass") + head)
                    out.append((old, len(before) + size, digest.hexdigest(), text_of(own),
                                text_of(edited), likeness(own, edited), likeness(own, sign)))
                was = None if later else (at, doc, keep, state, cut, sign)
            if out:
                yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next"]
    src = src.select("range", "later", F.col("doc_id").cast("string").alias("doc_id"), "text")
    return src.mapInPandas(
        run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double"
    ).withColumn("doc_id", F.col("doc_id").cast(kind))
