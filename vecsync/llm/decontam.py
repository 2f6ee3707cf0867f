"""Benchmark decontamination by greedy string tiling.

Words of a text and a benchmark item (lower case; runs of letters, digits and underscores,
and single characters of scripts written without spaces) are tiled: the longest match of unmarked words is marked on both sides, again and again,
until no match of ``shortest`` words is left.  Matches are found by running Karp-Rabin
hashes over unmarked windows and verified word by word.  An item's coverage is the share of
its words under tiles, in whatever order and with whatever between them, so reordered
passages count like untouched ones.  A text is contaminated by an item from ``threshold`` on.

Seeds decide what is tiled: windows of ``shortest`` words are looked up in the item's
windows, and a pair goes on only if its seeds could cover enough of the item.  An item of
fewer words is matched whole, by windows of its own length.

The benchmark is the stated query set; its distinct texts are worked off in blocks of about
``block_bytes``, one after the other: a block's seed index is all that reaches the driver and
tasks, its pairs are written before the next block comes, and the items that share a text
are joined to them afterwards.  Documents are never shuffled, so a passage that very many
documents share costs each of them its own tiling and nothing else.

Defined results
    null or empty text or item   no words, no match
    item under ``shortest`` words  covered, wholly, where its words stand in a row
    repeated items or rows       each is reported
    empty tables                 no pairs, all documents stay
    very long texts              tiled whole
    extra columns                never read; ``decontaminate`` returns them
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsync.llm.common import col, materialise, packed, slices, unpacked

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
            "\uf900-\ufaff\U00020000-\U0003ffff")
_spaced = re.compile(r"\w+").findall
_unspaced = re.compile(f"[{UNSPACED}]").search
_mixed = re.compile(rf"[{UNSPACED}]|(?:(?![{UNSPACED}])\w)+").findall


def tokens(text: str) -> list[str]:
    return _mixed(text) if not text.isascii() and _unspaced(text) else _spaced(text)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** n modulo 2 ** 64."""
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE))])


def running(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``width`` ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x, p = ids.astype(np.uint64) + np.uint64(1), powers(width)
    if width <= 16:
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h += x[k:k + n] * p[width - 1 - k]
        return h
    # BASE is odd, so it has an inverse and prefix sums of x[i] * BASE ** -i can be rolled
    inverse = np.uint64(pow(int(BASE), -1, 2 ** 64))
    back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(x) - 1, inverse))])
    total = np.concatenate([[np.uint64(0)], np.cumsum(x * back)])
    return (total[width:] - total[:-width]) * powers(len(x))[width - 1:width - 1 + n]


def _free(marked: np.ndarray, width: int) -> np.ndarray:
    total = np.r_[0, np.cumsum(marked)]
    return total[width:] == total[:-width]


def tiles(doc: np.ndarray, item: np.ndarray, shortest: int = 5) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length), longest first."""
    out: list[tuple[int, int, int]] = []
    on_doc, on_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    width = _longest(doc, item, on_doc, on_item, shortest, min(len(doc), len(item)))
    while width:
        free_d = np.flatnonzero(_free(on_doc, width))
        free_i = np.flatnonzero(_free(on_item, width))
        hashed_d, hashed_i = running(doc, width)[free_d], running(item, width)[free_i]
        order = np.argsort(hashed_i, kind="stable")
        hashed_i, free_i = hashed_i[order], free_i[order]
        low = np.searchsorted(hashed_i, hashed_d, "left")
        high = np.searchsorted(hashed_i, hashed_d, "right")
        for k in np.flatnonzero(high > low):
            at = int(free_d[k])
            for place in free_i[low[k]:high[k]].tolist():
                if (not on_doc[at:at + width].any() and not on_item[place:place + width].any()
                        and np.array_equal(doc[at:at + width], item[place:place + width])):
                    on_doc[at:at + width] = True
                    on_item[place:place + width] = True
                    out.append((at, place, width))
                    break
        width = _longest(doc, item, on_doc, on_item, shortest, width - 1)
    return out


def _matches(doc, item, on_doc, on_item, width: int) -> bool:
    d = running(doc, width)[_free(on_doc, width)]
    i = running(item, width)[_free(on_item, width)]
    return bool(len(d) and len(i) and np.isin(d, i).any())


def _longest(doc, item, on_doc, on_item, low: int, high: int) -> int:
    """The longest width from ``low`` to ``high`` with a match left, or 0: a match of some
    width holds matches of all smaller ones, so halving finds it."""
    if high < low or not _matches(doc, item, on_doc, on_item, low):
        return 0
    while low < high:
        mid = (low + high + 1) // 2
        if _matches(doc, item, on_doc, on_item, mid):
            low = mid
        else:
            high = mid - 1
    return low


class Block:
    """Seed index of a block of items: word numbers, and sorted window hashes with places."""

    def __init__(self, rows: list[tuple], shortest: int):
        self.number: dict[str, int] = {}
        self.shortest = shortest
        self.ids = [r[0] for r in rows]
        self.items = [np.array([self.number.setdefault(w, len(self.number))
                                for w in tokens((r[1] or "").lower())], dtype=np.int64)
                      for r in rows]
        seeds = [running(x, shortest) for x in self.items]
        of = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
        place = np.concatenate([np.arange(len(x)) for x in seeds] or [np.zeros(0, np.int64)])
        seed = np.concatenate(seeds or [np.zeros(0, np.uint64)])
        order = np.argsort(seed, kind="stable")
        self.seed, self.of, self.place = seed[order], of[order], place[order]
        self.seeds = np.unique(self.seed)
        #: items of fewer words, by their length
        self.short = {w: [i for i, x in enumerate(self.items) if len(x) == w]
                      for w in range(1, shortest)}

    def numbers(self, text: str | None) -> np.ndarray:
        """A text's words by the block's numbers; words that no item has are -1."""
        get = self.number.get
        return np.array([get(w, -1) for w in tokens((text or "").lower())], dtype=np.int64)

    def _whole(self, doc: np.ndarray) -> list[tuple[int, list]]:
        """The short items that stand in ``doc``, each with the first place."""
        out = []
        for width, own in self.short.items():
            if own and len(doc) >= width:
                seen = running(doc, width)
                wanted = np.concatenate([running(self.items[i], width) for i in own])
                for i, h in zip(own, wanted):
                    for at in np.flatnonzero(seen == h).tolist():
                        if np.array_equal(doc[at:at + width], self.items[i]):
                            out.append((i, [(at, 0, width)]))
                            break
        return out

    def search(self, text: str | None, threshold: float) -> list[tuple[int, list]]:
        """(index of an item, tiles) of all items that the text covers enough of."""
        doc = self.numbers(text)
        return self._whole(doc) + self._tiled(doc, threshold)

    def _tiled(self, doc: np.ndarray, threshold: float) -> list[tuple[int, list]]:
        k = self.shortest
        if len(doc) < k or not len(self.seeds):
            return []
        known = np.flatnonzero(_free(doc < 0, k))
        if not len(known):
            return []
        seed = running(doc, k)[known]
        at = np.minimum(np.searchsorted(self.seeds, seed), len(self.seeds) - 1)
        seed = np.unique(seed[self.seeds[at] == seed])
        if not len(seed):
            return []
        low = np.searchsorted(self.seed, seed, "left")
        many = np.searchsorted(self.seed, seed, "right") - low
        own = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        out = []
        pairs = np.unique(self.of[own] << 32 | self.place[own])
        for item in np.unique(pairs >> 32).tolist():
            words = self.items[item]
            place = pairs[(pairs >> 32) == item] & 0xFFFFFFFF
            reach = np.zeros(len(words) + 1, np.int64)
            np.add.at(reach, place, 1)
            np.add.at(reach, place + k, -1)
            if (np.cumsum(reach)[:-1] > 0).sum() >= threshold * len(words):
                found = tiles(doc, words, k)
                if sum(t[2] for t in found) >= threshold * len(words):
                    out.append((item, found))
        return out


def _texts(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The items: item_id, text, key (of equal texts)."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return benchmark.select(col(id_col).alias("item_id"), text.alias("text"),
                            F.sha2(text, 256).alias("key"))


def blocks(items: DataFrame, shortest: int, block_bytes: int) -> Iterator[tuple[Block, bool]]:
    """The distinct texts of ``items`` (key, text) in blocks of about ``block_bytes`` at most
    (or one text), one at a time, and whether more may follow."""
    texts = materialise(items.groupBy("key").agg(F.first("text").alias("text")),
                        "benchmark-texts")
    size = F.octet_length(F.col("text")) + 16
    n = math.ceil(2 * (texts.agg(F.sum(size.cast("long"))).first()[0] or 0) / block_bytes)
    part = F.pmod(F.xxhash64("key"), F.lit(n))
    for b in range(n):
        block = Block([tuple(r) for r in texts.filter(part == b).select("key", "text").collect()],
                      shortest)
        if any(len(x) for x in block.items):
            yield block, b + 1 < n


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shortest: int = 5,
          id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", block_bytes: int = 8_000_000) -> DataFrame:
    """Pairs of documents and items they cover enough of: doc_id, item_id, item_words,
    covered_words, coverage, tiles (places in the document and the item, and lengths)."""
    spark = docs.sparkSession
    kind = docs.select(col(id_col)).schema[0].dataType
    schema = ("doc_id string, key string, item_words long, covered_words long, coverage double, "
              "tiles array<struct<doc_at: long, item_at: long, words: long>>")
    src = docs.select(col(id_col).cast("string").alias("doc_id"),
                      col(text_col).cast("string").alias("text"))
    items = _texts(benchmark, item_col, item_text_col)

    def against(block: Block) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            b = sent.value
            for pdf in slices(batches, "text"):
                rows = []
                for doc, text in zip(pdf["doc_id"], pdf["text"]):
                    for item, found in b.search(text, threshold):
                        n, own = len(b.items[item]), sum(t[2] for t in found)
                        rows.append((doc, b.ids[item], n, own, own / n, [
                            {"doc_at": x, "item_at": y, "words": z} for x, y, z in found]))
                yield pd.DataFrame(rows, columns=["doc_id", "key", "item_words",
                                                  "covered_words", "coverage", "tiles"])

        return src.mapInPandas(run, schema)

    out = spark.createDataFrame([], schema)
    for block, more in blocks(items, shortest, block_bytes):
        found = against(block)
        out = out.unionByName(materialise(found, "leaks") if more else found)
    return (out.join(items.select("key", "item_id"), "key")
            .select(F.col("doc_id").cast(kind).alias("doc_id"), "item_id", "item_words",
                    "covered_words", "coverage", "tiles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8,
                  shortest: int = 5, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", block_bytes: int = 8_000_000) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with their own columns.  What one block
    leaves is written before the next one is read."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(packed(docs), col(text_col).cast("string").alias("text"))
    items = _texts(benchmark, item_col, item_text_col)
    for block, more in blocks(items, shortest, block_bytes):
        rows = rows.filter(_untouched(sc.broadcast(block), threshold)("text"))
        rows = materialise(rows, "untouched") if more else rows
    return unpacked(rows, docs.columns)


def _untouched(sent, threshold: float):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not sent.value.search(t, threshold) for t in texts], dtype=bool)

    return clean
