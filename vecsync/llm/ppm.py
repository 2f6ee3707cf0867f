"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ``ORDER`` symbols (bytes of the text with A-Z
in lower case, and a border symbol before and after it), learned from all training rows.
The probability of a symbol comes from its longest context that has been seen: (count - 1/2) /
total.  A symbol unseen there costs that context's escape, (distinct / 2) / total (method D),
and goes to the next shorter context, where the symbols of the longer one are excluded.  Below the
empty context all symbols not seen at all are equally likely.  A document's score is the
log10 probability of all its symbols, its code length up to a factor.

A unigram base with smoothed counts of words comes with it.

At scale: the trie is a table.  Symbol counts of all orders, context totals and exclusion
totals are aggregations and joins, and so is the log-probability of every distinct symbol in
context of the corpus.  Documents are scored where they are read, with the most frequent
words and contexts, a number fixed by parameters, sent to every task; what is not among those
meets the complete tables in a join.  So no result depends on what is sent, and nothing that
grows with the corpus is.

Defined results
    null or empty text     the end alone: one token, one symbol
    nothing to learn from  uniform over 257 symbols; base probability 1 for the end
    null identifiers       crc32 of the empty text decides
    equal rows             each has its own, equal, result
    empty table            empty result
    very long texts        whole; memory grows with the longest text
    extra columns          never read
"""
from __future__ import annotations

import math
from collections import Counter
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecsync.llm.common import col, crc_of_id, materialise, slices, words

ORDER = 5
BORDER = 256
SYMBOLS = 257
WIDE = 9                       # bits of a symbol
HOT_WORDS = 1 << 17
HOT_GRAMS = 1 << 21
# What a task holds beside its batch and its tables: characters counted or scored at once, grams
# kept before they are merged, and rows given to Spark at once.
SLICE = 500_000
SCORED = 250_000
KEPT = 2_000_000
GIVEN = 100_000


# -- symbols ------------------------------------------------------------------------------

def grams(texts, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(contexts with their symbol as numbers of 9 bits a symbol, first one of each text)."""
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    size = np.fromiter(map(len, data), np.int64, len(data))
    # each text: ``order`` borders, its bytes, one border
    at = np.cumsum(size + order + 1) - (size + order + 1)
    flat = np.full(int((size + order + 1).sum()), BORDER, np.int64)
    body = np.ones(len(flat), bool)
    for k in range(order):
        body[at + k] = False
    inner = body.copy()
    inner[at + size + order] = False
    flat[inner] = np.frombuffer(b"".join(data), np.uint8)
    code = flat.copy()
    for k in range(1, order + 1):
        code[k:] |= flat[:-k] << (WIDE * k)
    first = np.cumsum(size + 1) - (size + 1)
    return code[body], first


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are scored but not learned from: crc32 of the identifier mod 5 is 1."""
    return crc_of_id(id_col) % 5 == 1


def _source(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    return docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"),
                       held.alias("held_out"))


# -- counts -------------------------------------------------------------------------------

def merged(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One ascending (code, count) of several, each of which has a code once."""
    code = np.concatenate([k for k, _ in kept])
    code.sort()
    code = code[np.r_[True, code[1:] != code[:-1]]]
    many = np.zeros(len(code), np.int64)
    for own, n in kept:
        many[np.searchsorted(code, own)] += n
    return code, many


def gram_counts(src: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, learned, seen): counts in training rows and in all rows."""
    def run(batches):
        kept: list = []

        def rows(code, many):
            for at in range(0, len(code), GIVEN):
                c, n = code[at:at + GIVEN], many[at:at + GIVEN]
                yield pd.DataFrame({"gram": c >> 1, "learned": np.where(c & 1 == 0, n, 0),
                                    "seen": n})

        for pdf in slices(batches, "text", SLICE):
            code, first = grams(pdf["text"], order)
            many = np.diff(np.r_[first, len(code)])
            out = np.repeat(pdf["held_out"].to_numpy(bool).astype(np.int64), many)
            kept.append(np.unique(code << 1 | out, return_counts=True))
            if sum(len(k) for k, _ in kept) > KEPT:
                kept = [merged(kept)]
                if len(kept[0][0]) > KEPT * 3 // 4:
                    yield from rows(*kept[0])
                    kept = []
        if kept:
            kept = [merged(kept)]
            yield from rows(*kept[0])

    return (src.mapInPandas(run, "gram long, learned long, seen long")
            .groupBy("gram").agg(F.sum("learned").alias("learned"), F.sum("seen").alias("seen")))


def word_counts(src: DataFrame) -> DataFrame:
    """(word, n) of the training rows; the empty word stands for the end of a text."""
    def run(batches):
        count: Counter = Counter()

        def rows():
            own = iter(count.items())
            while some := list(islice(own, GIVEN)):
                yield pd.DataFrame(some, columns=["word", "n"])

        for pdf in slices(batches, "text"):
            for text in pdf["text"]:
                count.update(words(text))
            count[b""] += len(pdf)
            if len(count) > 500_000:
                yield from rows()
                count.clear()
        yield from rows()

    return (src.filter(~F.col("held_out")).mapInPandas(run, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


# -- trie ---------------------------------------------------------------------------------

def _orders(order: int) -> Column:
    return F.explode(F.array(*[F.lit(k) for k in range(order + 1)]))


def _mask(symbols: Column) -> Column:
    return F.pow(F.lit(2.0), symbols * WIDE).cast("long") - 1


def trie(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """entries (k, gram, e): count of a symbol in its context of order k;
    contexts (k, ctx, n, d, nx, dx): total and distinct symbols, and those of the next
    shorter context once this one's symbols are excluded."""
    k = F.col("k")
    level = counts.filter("learned > 0").select(F.lit(order).alias("k"), "gram",
                                                F.col("learned").alias("e"))
    entries = level
    for shorter in reversed(range(order)):              # each order from the next longer one
        level = materialise(
            level.groupBy(F.col("gram").bitwiseAND(_mask(F.lit(shorter + 1))).alias("gram"))
            .agg(F.sum("e").alias("e")).select(F.lit(shorter).alias("k"), "gram", "e"),
            "ppm-entries")
        entries = entries.unionByName(level)
    lower = entries.select((k + 1).alias("k"), F.col("gram").alias("tail"),
                           F.col("e").alias("below"))
    same = entries.withColumn("tail", F.col("gram").bitwiseAND(_mask(k)))
    totals = (same.join(lower, ["k", "tail"], "left")
              .groupBy("k", F.shiftright("gram", WIDE).alias("ctx"))
              .agg(F.sum("e").alias("n"), F.count(F.lit(1)).alias("d"),
                   F.coalesce(F.sum("below"), F.lit(0)).alias("covered")))
    totals = materialise(totals, "ppm-totals")
    short = totals.select((k + 1).alias("k"), F.col("ctx").alias("cut"),
                          F.col("n").alias("n_short"), F.col("d").alias("d_short"))
    contexts = (totals.withColumn("cut", F.when(k > 0, F.col("ctx").bitwiseAND(_mask(k - 1))))
                .join(short, ["k", "cut"], "left")
                .select("k", "ctx", "n", "d",
                        (F.coalesce("n_short", F.lit(0)) - F.col("covered")).alias("nx"),
                        (F.coalesce("d_short", F.lit(0)) - F.col("d")).alias("dx")))
    return entries, contexts


def log_probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, seen, lp): log10 probability of every gram's last symbol after the others."""
    entries, contexts = trie(counts, order)
    contexts = materialise(contexts, "ppm-contexts")
    k = F.col("k")
    # a gram that was learned needs its longest context only
    longest = contexts.filter(k == order).select("ctx", "n")
    known = (counts.filter("learned > 0").withColumn("ctx", F.shiftright("gram", WIDE))
             .join(longest, "ctx")
             .select("gram", "seen", F.log10((F.col("learned") - 0.5) / F.col("n")).alias("lp")))
    each = (counts.filter("learned = 0").select("gram", "seen").withColumn("k", _orders(order))
            .withColumn("own", F.col("gram").bitwiseAND(_mask(k + 1)))
            .withColumn("ctx", F.shiftright("own", WIDE)))
    met = (each.join(entries.withColumnRenamed("gram", "own"), ["k", "own"], "left")
           .join(contexts, ["k", "ctx"], "left"))
    level = F.struct("e", "n", "d", "nx", "dx")
    wide = met.groupBy("gram").agg(F.max("seen").alias("seen"), *[
        F.max(F.when(k == i, level)).alias(f"k{i}") for i in range(order + 1)])
    distinct = F.coalesce(F.col("k0.d"), F.lit(0))
    lp = -F.log10(F.greatest(F.lit(float(SYMBOLS)) - distinct, F.lit(1.0)))
    # from the empty context upwards: ``plain`` without exclusion, ``after`` with the symbols
    # of the next longer context excluded
    plain, after = lp, lp
    for i in range(order + 1):
        x = F.col(f"k{i}")
        e, n, d = x["e"], x["n"].cast("double"), x["d"].cast("double")
        to_here = (F.col(f"k{i + 1}") if i < order else None)
        own = F.when(n.isNull(), plain).when(e.isNotNull(), F.log10((e - 0.5) / n)).otherwise(
            F.log10(0.5 * d / n) + after)
        if to_here is not None:
            nx, dx = to_here["nx"].cast("double"), to_here["dx"].cast("double")
            # null where nothing is left: then the longer context has the symbol
            after = F.when(e.isNotNull(), F.log10(F.try_divide(e - 0.5, nx))).otherwise(
                F.when(dx > 0, F.log10(F.try_divide(0.5 * dx, nx))).otherwise(F.lit(0.0))
                + after)
        wide = wide.withColumn(f"p{i}", own)
        if to_here is not None:
            wide = wide.withColumn(f"a{i}", after)
            after = F.col(f"a{i}")
        plain = F.col(f"p{i}")
    return known.unionByName(wide.select("gram", "seen", plain.alias("lp")))


# -- scores -------------------------------------------------------------------------------

def _most_frequent(table: DataFrame, n: str, most: int) -> DataFrame:
    """Rows with the highest counts, ``most`` at most: from the least count for which no
    more have it.  Only a histogram of about 500 classes reaches the driver."""
    kind = F.floor(F.log2(F.col(n).cast("double")) * 8)
    classes = sorted(table.filter(F.col(n) > 0).groupBy(kind.alias("c")).count().collect(),
                     reverse=True)
    total, least = 0, None
    for c, many in classes:
        total += many
        if total > most:
            break
        least = c
    return table.filter((F.col(n) > 0) & (kind >= least)) if least is not None else \
        table.limit(0)


class Lookup:
    """A fixed hash table from different grams to log-probability, half full at most: places in
    the two arrays as they came, so that it adds little to them.  Misses give NaN."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, step: int = 1 << 17):
        self.shift = np.uint64(64 - max(4, math.ceil(math.log2(max(1, 2 * len(keys))))))
        self.keys, self.values = keys, values
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        # some at a time: all at once would take the table's memory again
        for lo in range(0, len(keys), step):
            self._put(np.arange(lo, min(lo + step, len(keys)), dtype=np.int32))

    def _put(self, left: np.ndarray) -> None:
        at = self._home(self.keys[left])
        while len(left):
            free = self.slots[at] == -1
            self.slots[at[free]] = left[free]           # of several, one stays
            on = self.slots[at] != left
            left, at = left[on], (at[on] + 1) % len(self.slots)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(
            np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), np.nan)
        if not len(self.keys):
            return out
        at = self._home(keys)
        left = np.arange(len(keys))
        while len(left):
            there = self.slots[at]
            hit = (self.keys[there] == keys[left]) & (there >= 0)
            out[left[hit]] = self.values[there[hit]]
            on = ~hit & (there >= 0)
            left, at = left[on], (at[on] + 1) % len(self.slots)
        return out


class Sent:
    """What goes to the tasks: where it arrives it becomes (known words, ``Lookup``), once per
    worker."""

    def __init__(self, known: dict[bytes, float], keys: np.ndarray, values: np.ndarray):
        self.parts = known, keys, values

    def __reduce__(self):
        return _arrived, self.parts


def _arrived(known: dict[bytes, float], keys: np.ndarray, values: np.ndarray) -> tuple:
    return known, Lookup(keys, values)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           held: Column | None = None, order: int = ORDER, hot_words: int = HOT_WORDS,
           hot_grams: int = HOT_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row."""
    spark = docs.sparkSession
    src = _source(docs, id_col, text_col, held_out(id_col) if held is None else held)
    vocabulary = materialise(word_counts(src), "ppm-words")
    total, kinds = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)),
                                  F.count(F.lit(1))).first()
    below = total + 0.5 * (kinds + 1)
    # lengths bound what is sent; longer words wait for the join
    sent_words = _most_frequent(vocabulary.filter(F.octet_length("word") <= 64), "n",
                                hot_words).select("word", "n").toArrow()
    ends = vocabulary.filter(F.octet_length("word") == 0).first()
    chances = materialise(log_probabilities(materialise(gram_counts(src, order), "ppm-grams"),
                                            order), "ppm-chances")
    sent_grams = _most_frequent(chances, "seen", hot_grams).select("gram", "lp").toArrow()
    sent = spark.sparkContext.broadcast(Sent(
        {bytes(w): math.log10((n + 0.5) / below)
         for w, n in zip(sent_words["word"].to_pylist(), sent_words["n"].to_pylist())},
        sent_grams["gram"].to_numpy(), sent_grams["lp"].to_numpy()))
    end = math.log10(((ends["n"] if ends else 0) + 0.5) / below)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        known, look = sent.value
        get = known.get
        for pdf in slices(batches, "text", SCORED):
            code, first = grams(pdf["text"], order)
            lp = look(code)
            missed = np.flatnonzero(np.isnan(lp))
            of = np.searchsorted(first, missed, "right") - 1
            lp[missed] = 0
            tail_grams: list[list] = [[] for _ in range(len(pdf))]
            if len(missed):
                for d in np.unique(of).tolist():
                    g, m = np.unique(code[missed[of == d]], return_counts=True)
                    tail_grams[d] = [{"gram": int(a), "m": int(b)} for a, b in zip(g, m)]
            frame = {"n_tokens": [], "hits": [], "base": [], "tail_words": []}
            for text in pdf["text"]:
                own = words(text)
                found = [get(w) for w in own]
                rest = Counter([w for w, p in zip(own, found) if p is None])
                hits = [p for p in found if p is not None]
                frame["n_tokens"].append(len(own) + 1)
                frame["hits"].append(len(hits) + (total > 0))
                frame["base"].append(math.fsum(hits) + end)
                frame["tail_words"].append([{"word": w, "m": m} for w, m in rest.items()])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(),
                                "held_out": pdf["held_out"].to_numpy(), **frame,
                                "part": np.add.reduceat(lp, first), "tail_grams": tail_grams})

    seen = src.mapInPandas(run, f"doc_id {kind}, held_out boolean, n_tokens long, hits long, "
                                "base double, tail_words array<struct<word: binary, m: long>>, "
                                "part double, tail_grams array<struct<gram: long, m: long>>")
    # numbered once: from here on the numbers are read from the files
    rows = materialise(seen.withColumn("row", F.monotonically_increasing_id()), "ppm-rows")
    by_word = (rows.select("row", F.inline("tail_words")).join(vocabulary, "word", "left")
               .groupBy("row").agg(
                   F.sum(F.col("m") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / below))
                   .alias("base_tail"),
                   F.sum(F.when(F.col("n") > 0, F.col("m"))).alias("hits_tail")))
    by_gram = (rows.select("row", F.inline("tail_grams")).join(chances, "gram", "left")
               .groupBy("row").agg(F.sum(F.col("m") * F.col("lp")).alias("part_tail")))
    zero = F.lit(0)
    return (rows.drop("tail_words", "tail_grams").join(by_word, "row", "left")
            .join(by_gram, "row", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("hits") + F.coalesce("hits_tail", zero)).alias("n_known"),
                    F.lit(total).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("base_tail", zero)).alias("base_score"),
                    (F.col("part") + F.coalesce("part_tail", zero)).alias("score")))
