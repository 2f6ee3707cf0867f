"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within ``radius`` bits have a common variant within half of it of
both.  So every distinct fingerprint emits all variants in that ball, variants meet by a
shuffle, and fingerprints that share one are linked once their distance has been verified.

The shuffle carries a variant's leading bits only: a fingerprint goes once to each prefix
that its variants have, and the rest of a variant is spelt out where it lands.  That moves
1 + p + p(p-1)/2 rows a fingerprint in place of all 2,081 variants and meets the same
variants.  p follows the number of fingerprints.  Prefixes are counted, and one that more
than ``GROUP`` fingerprints share is split by four further bits at a time, in the same way.
Where all fingerprints of a prefix would have to flip one and the same bit to get there, the
prefix adds nothing: the same fingerprints meet where none of them flips it.  Inside a task,
too many variants for its memory are worked off by further leading bits, one after the other.

Fingerprints that meet in one variant form a star around the smallest; stars are folded into
a forest as they are found, and a task sends the forest, never all pairs.  Components come
from ``components``.

Defined results
    null, empty or wordless text   fingerprint zero, linked like any other
    fewer words than a shingle     one shingle of all words
    equal identifiers              each row has the component of its own text; the
                                   component is the smallest identifier of all its rows
    null identifier                has a component of its links; null if all are null
    equal rows but for a column    ``deduplicate`` keeps the one with the least hash
    empty table                    empty result
    extra columns                  kept by ``deduplicate``, whatever their names
"""
from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsync.llm.common import (col, id_keys, materialise, one_of_each, packed, per_text, slices,
                                unpacked, words)
from vecsync.llm.components import components

SEED = 42
BITS = 64
ROOM = 2_000_000          # variants that a task spells out at a time
GROUP = 1 << 16           # fingerprints of one prefix in one task, about


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bit k is 1 where over half of the shingles' XXH64 values have it."""
    toks = words(text)
    if not toks:
        return 0
    line = memoryview(b" ".join(toks))
    size = np.fromiter(map(len, toks), np.int64, len(toks)) + 1
    end = np.cumsum(size) - 1
    n = max(1, len(toks) - shingle + 1)
    first = (end - size + 1)[:n].tolist()
    last = end[min(shingle, len(toks)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(first, last)], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) with fp as a signed long, one row per row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(pdf):
        return pd.DataFrame({"doc_id": pdf["doc_id"],
                             "fp": _signed([fingerprint(t, shingle) for t in pdf["text"]])})

    return per_text(docs, id_col, text_col, run, f"doc_id {kind}, fp long")


def flips(bits: int, most: int, at: int = 0) -> list[int]:
    """Masks of up to ``most`` set bits among ``bits`` bits from bit ``at`` on."""
    return [sum(1 << (at + b) for b in c) for k in range(most + 1)
            for c in combinations(range(bits), k)]


def _stars(v: np.ndarray, who: np.ndarray, fps: np.ndarray, radius: int,
           root: np.ndarray) -> None:
    """Fold the links of fingerprints that share a variant, each to the smallest of its run,
    into the forest ``root``."""
    order = np.argsort(v, kind="stable")
    v, who = v[order], who[order]
    same = v[1:] == v[:-1]
    hit = np.zeros(len(v), bool)
    hit[1:] |= same
    hit[:-1] |= same
    v, who = v[hit], who[hit]
    if not len(v):
        return
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    low = np.repeat(np.minimum.reduceat(who, start), np.diff(np.r_[start, len(v)]))
    pair = np.unique(low.astype(np.int64) << 32 | who)
    a, b = pair >> 32, pair & 0xFFFFFFFF
    near = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= radius)
    _fold(root, a[near], b[near])


def _meet(fps: np.ndarray, who: np.ndarray, left: np.ndarray, rest: int, radius: int,
          root: np.ndarray) -> None:
    """Fold the links among ``who``, whose variants here agree above the lowest ``rest`` bits
    and may still flip ``left`` bits of those, into ``root``."""
    low = np.uint64((1 << rest) - 1) if rest < 64 else np.uint64(2 ** 64 - 1)
    many = sum(math.comb(rest, k) * int((left >= k).sum()) for k in range(int(left.max()) + 1))
    if many <= ROOM or rest <= 4:
        vs, ws = [], []
        for most in range(int(left.max()) + 1):
            own = who[left == most]
            if len(own):
                masks = np.array(flips(rest, most), dtype=np.uint64)
                vs.append(((fps[own] & low)[:, None] ^ masks[None, :]).ravel())
                ws.append(np.repeat(own, len(masks)))
        _stars(np.concatenate(vs), np.concatenate(ws), fps, radius, root)
        return
    step = min(4, rest)
    head = (fps[who] & low) >> np.uint64(rest - step)
    for value in range(1 << step):
        flip = head ^ np.uint64(value)
        still = left - np.bitwise_count(flip).astype(left.dtype)
        on = still >= 0
        # a bit that all flip: they meet where none does
        if on.sum() > 1 and not np.bitwise_and.reduce(flip[on]):
            _meet(fps, who[on], still[on], rest - step, radius, root)


def _fold(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Add links to the forest: every node points to the smallest of its component."""
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while (root[root] != root).any():
            root[:] = root[root]
        on = root[a] != root[b]
        a, b = a[on], b[on]


def _prefixes(fps: DataFrame, p: int, half: int) -> list[DataFrame]:
    """Rows (p, prefix, fp): every fingerprint under every prefix of its variants, prefixes
    that too many share split by further bits.  Prefixes that add nothing are left out where
    they are split."""
    masks = F.array(*[F.lit(m) for m in flips(p, half)])
    rows = fps.select("fp", F.explode(masks).alias("flip")).select(
        F.lit(p).alias("p"), "fp", F.shiftrightunsigned("fp", BITS - p).bitwiseXOR(F.col("flip"))
        .alias("prefix"), "flip")
    done, step = [], 4
    four = F.array(*[F.lit(m) for m in flips(step, half)])
    while p + step <= BITS - 4:
        many = (rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"),
                                           F.bit_and("flip").alias("all"))
                .filter(F.col("n") > GROUP))
        many = materialise(many, "simhash-prefixes")        # at most rows / GROUP of them
        if many.isEmpty():
            break
        done.append(rows.join(many, "prefix", "left_anti"))
        p += step
        head = F.shiftrightunsigned("fp", BITS - p)
        rows = (rows.join(many.filter("all = 0"), "prefix", "left_semi")
                .withColumn("more", F.explode(four))
                .withColumn("flip", F.shiftleft("flip", step).bitwiseOR(F.col("more")))
                .filter(F.bit_count("flip") <= half)
                .select(F.lit(p).alias("p"), "fp", head.bitwiseXOR(F.col("flip")).alias("prefix"),
                        "flip"))
        rows = materialise(rows, "simhash-split")
    return [*done, rows]


def ball_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(u, v): spanning links of distinct fingerprints (column fp) within ``radius`` bits."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius is split into two equal halves: give an even number")
    half = radius // 2
    n = fps.count()
    ball = sum(math.comb(BITS, k) for k in range(half + 1))
    p = min(24, max(4, math.ceil(math.log2(max(2, n) * ball / (ROOM // 8)))))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        bits, prefix = key
        own = np.unique(pdf["fp"].to_numpy()).view(np.uint64)
        flip = (own >> np.uint64(BITS - bits)) ^ np.uint64(prefix)
        root = np.arange(len(own))
        if len(own) > 1 and not np.bitwise_and.reduce(flip):
            left = half - np.bitwise_count(flip).astype(np.int64)
            _meet(own, root.copy(), left, BITS - int(bits), radius, root)
        b = np.flatnonzero(root != np.arange(len(own)))
        a = root[b]
        return pd.DataFrame({"u": own[a].view(np.int64), "v": own[b].view(np.int64)})

    sent, *more = _prefixes(fps, p, half)
    for rows in more:
        sent = sent.unionByName(rows)
    return (sent.select("p", "prefix", "fp").groupBy("p", "prefix")
            .applyInPandas(run, "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    own = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-own")
    root = own.join(components(ball_links(own.select("fp"), radius)),
                    F.col("fp") == F.col("node"), "left")
    root = materialise(root.select("fp", "low", F.coalesce("root", "fp").alias("root")),
                       "simhash-root")
    least = root.groupBy("root").agg(F.min("low").alias("component_id"))
    group = materialise(root.join(least, "root").select("fp", "component_id"), "simhash-group")
    return fps.join(group, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest
    identifier (then the smallest text digest), with its own columns."""
    digest = F.sha2(F.coalesce(col(text_col).cast("string"), F.lit("")), 256)
    keyed = docs.select(col(id_col).alias("id"), col(text_col).alias("text"),
                        digest.alias("digest"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in slices(batches, "text"):
            yield pd.DataFrame({"id": pdf["id"], "digest": pdf["digest"],
                                "fp": _signed([fingerprint(t, shingle) for t in pdf["text"]])})

    rows = keyed.mapInPandas(run, f"id {kind}, digest string, fp long")
    # a null identifier comes after all others
    key = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    own = materialise(rows.groupBy("fp").agg(F.min(key).alias("low")), "simhash-own")
    root = (own.join(components(ball_links(own.select("fp"), radius)),
                     F.col("fp") == F.col("node"), "left")
            .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("low").alias("low")))
    won = materialise(root.select("low.id", "low.digest"), "simhash-won")
    own = ["id_none", "id_text", "digest"]
    full = docs.select(packed(docs), *id_keys(id_col), digest.alias("digest"))
    kept = full.join(won.select(*id_keys("id"), "digest"), own, "left_semi")
    return unpacked(one_of_each(kept, own), docs.columns)
