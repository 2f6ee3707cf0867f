"""Sharding by a k-d tree over metadata, with equal bytes in every shard.

The root stands for all shards.  A node that stands for k of them is split along its widest
dimension, at the weighted quantile that gives floor(k / 2) and ceil(k / 2) shards their part
of its bytes, until every leaf is one shard of the target bytes.  All nodes of a level are
split together: tasks sum histograms of bytes over the interval that holds each node's
quantile, and the interval shrinks to the bin that has it, pass by pass, down to one key.  A
dimension's key ends in random bits of the row, so equal values can be split anywhere.

Only histograms reach the driver: at most ``BINS`` rows for each node of a level.

Law ``bytes``: shards differ by about one document.

Defined results
    null text              no bytes; every row counts 16 besides
    null metadata          a value of its own, before all others
    equal identifiers      rows of their own, as are repeated rows
    one huge document      a shard cannot be smaller than it; others may stay empty
    empty table            empty result
    extra columns          never read, unless named as a dimension
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecsync.llm.common import col, materialise

BINS = 512
CODE = (1 << 31) - 1
SLOT_ROWS = 20_000            # rows that one task numbers, about


@dataclass
class Tree:
    """Node i splits dimension ``dim[i]`` (-1: a leaf) after key ``cut[i]`` into the nodes
    ``left[i]`` and the one after it; ``shards[i]`` are the shards that it stands for."""

    dim: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    shards: list = field(default_factory=list)

    def leaf_of(self, keys: np.ndarray) -> np.ndarray:
        """The leaf of every row of keys (rows by dimensions)."""
        dim, cut, left = np.array(self.dim), np.array(self.cut, np.int64), np.array(self.left)
        at = np.zeros(len(keys), np.int64)
        rows = np.arange(len(keys))
        while len(rows):
            rows = rows[dim[at[rows]] >= 0]
            own = at[rows]
            at[rows] = left[own] + (keys[rows, dim[own]] > cut[own])
        return at

    def split(self, node: int, dim: int, cut: int) -> None:
        first, last = self.shards[node]
        half = first + (last - first) // 2
        self.dim[node], self.cut[node], self.left[node] = dim, cut, len(self.dim)
        for part in ((first, half), (half, last)):
            self.dim.append(-1)
            self.cut.append(0)
            self.left.append(-1)
            self.shards.append(part)

    def open(self) -> list[int]:
        return [i for i, d in enumerate(self.dim)
                if d < 0 and self.shards[i][1] - self.shards[i][0] > 1]


def _codes(df: DataFrame, dims: list[str]) -> list[Column]:
    """Each dimension as a number from 0 to ``CODE``: numbers on their own scale, everything
    else by a hash; null is 0."""
    numeric = [d for d in dims if isinstance(df.schema[d].dataType, T.NumericType)]
    ends = df.agg(*[f(col(d).cast("double")).alias(f"{f.__name__}{i}")
                    for i, d in enumerate(numeric) for f in (F.min, F.max)]).first() \
        if numeric else None
    out = []
    for d in dims:
        if d in numeric:
            i = numeric.index(d)
            low, high = ends[f"min{i}"] or 0.0, ends[f"max{i}"] or 0.0
            code = F.round((col(d).cast("double") - low) / max(high - low, 1e-300) * (CODE - 1)
                           if high > low else F.lit(0.0)).cast("long") + 1
        else:
            code = F.shiftrightunsigned(F.xxhash64(col(d).cast("string")), 33)
        out.append(F.when(col(d).isNull(), F.lit(0).cast("long")).otherwise(
            F.least(code, F.lit(CODE).cast("long"))))
    return out


def _ranges(rows: DataFrame, tree: Tree, dims: int) -> pd.DataFrame:
    """node, dim, low, high (keys), bytes: of every open node."""
    want = tree.open()

    def run(batches):
        for pdf in batches:
            keys = np.vstack(pdf["keys"].to_numpy()) if len(pdf) else np.zeros((0, dims))
            leaf, size = tree.leaf_of(keys), pdf["size"].to_numpy()
            for node in np.intersect1d(leaf, want):
                own = leaf == node
                yield pd.DataFrame({"node": node, "dim": range(dims),
                                    "low": keys[own].min(axis=0), "high": keys[own].max(axis=0),
                                    "bytes": size[own].sum()})

    return (rows.select("keys", "size")
            .mapInPandas(run, "node int, dim int, low long, high long, bytes long")
            .groupBy("node", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high"),
                                        F.sum("bytes").alias("bytes")).toPandas())


def _histogram(rows: DataFrame, tree: Tree, within: dict[int, tuple]) -> pd.DataFrame:
    """node, bin, bytes, low, high: of the keys inside each node's interval (dim, low, high)."""
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            keys, size = np.vstack(pdf["keys"].to_numpy()), pdf["size"].to_numpy()
            leaf = tree.leaf_of(keys)
            for node, (dim, low, high) in within.items():
                key = keys[:, dim]
                own = (leaf == node) & (key >= low) & (key <= high)
                k, w = key[own], size[own]
                if len(k):
                    # the ends of the interval get the first and the last bin
                    b = ((k - low).astype(float) / float(high - low) * (BINS - 1)).astype(int)
                    order = np.argsort(b, kind="stable")
                    b, k, w = b[order], k[order], w[order]
                    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                    yield pd.DataFrame({
                        "node": node, "bin": b[at], "bytes": np.add.reduceat(w, at),
                        "low": np.minimum.reduceat(k, at), "high": np.maximum.reduceat(k, at)})

    return (rows.select("keys", "size")
            .mapInPandas(run, "node int, bin int, bytes long, low long, high long")
            .groupBy("node", "bin").agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"),
                                        F.max("high").alias("high")).toPandas())


def grow(rows: DataFrame, dims: int, shards: int) -> Tree:
    """The tree of ``rows`` (keys: an array of a key per dimension; size)."""
    tree = Tree(shards=[(0, shards)])
    whole = None
    while tree.open():
        found = _ranges(rows, tree, dims)
        found["wide"] = (found["high"] // (1 << 32)) - (found["low"] // (1 << 32))
        if whole is None:
            whole = found.set_index("dim")["wide"].clip(lower=1) if len(found) else {}
        work: dict[int, tuple] = {}
        need, below = {}, {}
        for node in tree.open():
            own = found[found["node"] == node]
            first, last = tree.shards[node]
            if not len(own):                               # no row: any cut will do
                tree.split(node, 0, 0)
                continue
            best = max(own.itertuples(), key=lambda r: (r.wide / whole[r.dim], -r.dim))
            work[node] = (int(best.dim), int(best.low), int(best.high))
            need[node] = best.bytes * ((last - first) // 2) / (last - first)
            below[node] = 0
        cuts: dict[int, tuple[int, int]] = {}
        while work:
            for node in [n for n, (_, low, high) in work.items() if low == high]:
                dim, low, _ = work.pop(node)
                cuts[node] = (dim, low)
            if not work:
                break
            counted = _histogram(rows, tree, work)
            for node in list(work):
                dim = work[node][0]
                h = counted[counted["node"] == node].sort_values("bin")
                upto = below[node] + h["bytes"].cumsum().to_numpy()
                k = min(int(np.searchsorted(upto, need[node])), len(h) - 1)
                low, high = int(h["low"].iloc[k]), int(h["high"].iloc[k])
                before = upto[k] - h["bytes"].iloc[k]
                if low == high:                            # one key: on the nearer side
                    del work[node]
                    take = upto[k] - need[node] <= need[node] - before
                    cuts[node] = (dim, low if take else low - 1)
                else:
                    work[node], below[node] = (dim, low, high), before
        for node, (dim, cut) in cuts.items():
            tree.split(node, dim, cut)
    return tree


def assign(docs: DataFrame, shards: int, dims: list[str], id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row of ``docs``; the slots
    of a shard count up from 0 without a gap."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    random = F.xxhash64(col(id_col), F.monotonically_increasing_id()).bitwiseAND(
        F.lit((1 << 32) - 1))
    keys = F.array(*[F.shiftleft(c, 32).bitwiseOR(random) for c in _codes(docs, dims)])
    # written once: the random bits of a row are read from the files from here on
    rows = materialise(docs.select(
        col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), keys.alias("keys")), "shard-keys")
    tree = grow(rows, len(dims), shards)
    first = np.array([s[0] for s in tree.shards])
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if len(pdf):
                leaf = tree.leaf_of(np.vstack(pdf["keys"].to_numpy()))
                yield pdf.drop(columns="keys").assign(shard=first[leaf].astype(np.int32))

    placed = rows.mapInPandas(run, f"doc_id {kind}, size long, text_crc32 long, shard int")
    parts = max(1, -(-rows.count() // (shards * SLOT_ROWS)))
    placed = materialise(placed.withColumn("part", (F.rand(7) * parts).cast("int")),
                         "shard-rows")
    many = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = many.select("shard", "part", F.coalesce(F.sum("n").over(order), F.lit(0))
                         .alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id",
                                                                             "text_crc32")) - 1
    return (placed.withColumn("inside", inside).join(before, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("inside")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
