"""Source divergence audit: how far the sources of a language differ in their terms.

Duplicate-text collapse: identical texts of a language become one row that carries how many
documents of each source hold it, so each distinct text is cut into terms once; its counts
and document frequencies are added with those multiplicities.  Tasks add up before anything
is shuffled.  Pairs of sources are evaluated sparsely: with p0 the share a source gives a
term it lacks,

    sum |p_i - p_j|  =  V |p0_i - p0_j|  +  sum over i's terms (|p_i - p0_j| - |p0_i - p0_j|)
                                         +  sum over j's terms (|p_j - a_i| - |p0_j - a_i|)

(a_i: p_i or p0_i), so only terms that one of the two has are visited, in buckets of terms
and blocks of sources.

Defined results
    null text, lang, source  count as the empty string
    empty or term-less text  its document still makes its (lang, source) group occur
    a lang without terms     V = 0: pairs of value 0, no terms
    ties                     equal values by ascending item (UTF-8)
    repeated rows            each is a document
    very long texts          whole; a task's tables are written out at ``ROOM`` entries
    empty table              empty result
    extra columns            ignored, whatever their names
Bounds: a collapsed row lists each source of its lang at most once; the rows of one term are
one for each source of its lang.  Nothing is collected to the driver.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecsync.llm.common import col, materialise, slices

#: Bytes of terms (letters, and all of other scripts) as they are, A-Z lower, the rest blank.
TERM = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32
             for c in range(256))
ROOM = 400_000
BUCKET_TERMS, BLOCK_SOURCES = 1024, 256
SCALE = 1_000_000_000


def collapse(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
             source_col: str = "source") -> DataFrame:
    """One row for each lang and distinct text: lang, digest, text, held (source, n)."""
    def given(name):
        return F.coalesce(col(name).cast("string"), F.lit(""))

    rows = (docs.select(given(lang_col).alias("lang"), given(source_col).alias("source"),
                        given(text_col).alias("text"))
            .withColumn("digest", F.unhex(F.sha2("text", 256))))
    texts = rows.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    held = (rows.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("lang", "digest")
            .agg(F.collect_list(F.struct("source", "n")).alias("held")))
    return texts.join(held, ["lang", "digest"])


def _tally(batches):
    """Counts and document frequencies of the terms of each (lang, source), added up here."""
    room = {}

    def out():
        for (lang, source), (count, docs) in room.items():
            terms = list(count)
            if not terms:
                continue
            yield pd.DataFrame({"lang": lang, "source": source,
                                "term": [t.decode("utf-8", "replace") for t in terms],
                                "count": [count[t] for t in terms],
                                "docs": [docs[t] for t in terms]})
        room.clear()

    for pdf in slices(batches, "text"):
        for lang, text, held in zip(pdf["lang"], pdf["text"], pdf["held"]):
            terms = text.encode("utf-8", "surrogatepass").translate(TERM).split()
            distinct, once = set(terms), None
            for h in held:
                key, n = (lang, h["source"]), h["n"]
                if key not in room:
                    room[key] = Counter(), Counter()
                count, docs = room[key]
                if n == 1:
                    count.update(terms)
                    docs.update(distinct)
                else:
                    once = Counter(terms) if once is None else once
                    for t, c in once.items():
                        count[t] += c * n
                        docs[t] += n
        if sum(len(c) for c, _ in room.values()) > ROOM:
            yield from out()
    yield from out()


def term_counts(docs: DataFrame, least_docs: int = 30, text_col: str = "text",
                lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Kept terms: lang, source, term, count (> 0), lang_count, head (one row of each term)."""
    rows = collapse(docs, text_col, lang_col, source_col).select("lang", "text", "held")
    tally = rows.mapInPandas(_tally, "lang string, source string, term string, count long, "
                                     "docs long")
    # one shuffle: by (lang, term), which serves the sums of sources and of langs
    counts = (tally.repartition("lang", "term").groupBy("lang", "term", "source")
              .agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")))
    one = Window.partitionBy("lang", "term")
    return (counts.withColumn("lang_docs", F.sum("docs").over(one))
            .withColumn("lang_count", F.sum("count").over(one))
            .withColumn("head", F.row_number().over(one.orderBy("source")) == 1)
            .filter(F.col("lang_docs") >= least_docs)
            .select("lang", "source", "term", "count", "lang_count", "head"))


def _share(count, total, kept):
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact beyond 64 bits; null if none."""
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(10,0)) * "
                  f"CAST({count} + 5 AS DECIMAL(20,0))) div "
                  f"CAST({total} + 5 * {kept} AS DECIMAL(20,0)) END")


def _pairs(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """What the terms of one bucket add to each pair of sources of two blocks.  Every source of
    the blocks has a row without a term, so one that lacks all terms of the bucket counts too."""
    lang, _, a, b = key
    marks = pdf[pdf["term"].isna()].sort_values("source", ignore_index=True)
    names, base = marks["source"].tolist(), marks["p0"].to_numpy(np.int64)
    block = marks["block"].to_numpy()
    cells = pdf[pdf["term"].notna()]
    owner = cells["source"].map({s: i for i, s in enumerate(names)}).to_numpy(np.int64)
    order = np.argsort(owner, kind="stable")
    cells, owner = cells.iloc[order], owner[order]
    term = pd.factorize(cells["term"])[0]
    share, none = cells["p"].to_numpy(np.int64), base[owner]
    ends = np.cumsum(np.bincount(owner, minlength=len(names)))
    out = []
    for i in np.flatnonzero(block == a):
        mine = slice(ends[i - 1] if i else 0, ends[i])
        full = np.full(term.max(initial=0) + 1, base[i], np.int64)
        full[term[mine]] = share[mine]
        at = full[term]
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, owner, np.abs(share - at) - np.abs(none - at))
        own = share[mine]
        for j in np.flatnonzero((block == b) & (np.arange(len(names)) > (i if a == b else -1))):
            value = int(sums[j] + (np.abs(own - base[j]) - abs(int(base[i] - base[j]))).sum())
            out.append((lang, names[i], names[j], value))
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, text_col: str = "text",
               lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (``pair``, ``term``), item, value, rank: every other source of the
    lang by distance, and the ``top`` kept terms that the source has above its lang."""
    kept = materialise(term_counts(docs, least_docs, text_col, lang_col, source_col),
                       "divergence-terms")
    langs = kept.groupBy("lang").agg(
        F.sum(F.when(F.col("head"), 1).otherwise(0)).alias("v"),
        F.sum(F.when(F.col("head"), F.col("lang_count")).otherwise(0)).alias("lang_n"))
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    seen = (docs.select(F.coalesce(col(lang_col).cast("string"), F.lit("")).alias("lang"),
                        F.coalesce(col(source_col).cast("string"), F.lit("")).alias("source"))
            .distinct())
    sources = seen.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    groups = (seen.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .join(sources, "lang").na.fill(0, ["n", "v", "lang_n"])
              .withColumn("blocks", F.ceil(F.col("sources") / BLOCK_SOURCES))
              .withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
              .withColumn("p0", _share("0", "n", "v")))
    groups = materialise(groups, "divergence-groups")     # its written size tells the planner

    held = kept.join(groups, ["lang", "source"]).withColumn("p", _share("count", "n", "v"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = (held.withColumn("q", _share("lang_count", "lang_n", "v")).filter("p > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     (F.col("p") - F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top))

    # a row meets every block of its lang's sources, in the bucket of its term
    buckets = F.ceil(F.col("v") / BUCKET_TERMS)
    own = ["lang", "bucket", "blocks", "block", "source", "term", "p", "p0"]
    cells = held.withColumn("bucket", F.pmod(F.xxhash64("term"), buckets)).select(own)
    marks = (groups.filter("v > 0").withColumn("term", F.lit(None).cast("string"))
             .withColumn("p", F.lit(None).cast("long"))
             .withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1))))
    met = (cells.unionByName(marks.select(own))
           .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
           .select("lang", "bucket", F.least("block", "other").alias("a"),
                   F.greatest("block", "other").alias("b"), "block", "source", "term", "p", "p0"))
    part = (met.groupBy("lang", "bucket", "a", "b")
            .applyInPandas(_pairs, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    part = part.unionByName(part.select("lang", F.col("item").alias("source"),
                                        F.col("source").alias("item"), "value"))
    mine = groups.select("lang", "source", "v", F.col("p0").alias("mine"))
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("theirs"))
    base = mine.join(theirs, "lang").filter("source <> item")
    apart = (base.join(part, ["lang", "source", "item"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     F.expr("coalesce(v * abs(mine - theirs), 0) + coalesce(value, 0)")
                     .alias("value"))
             .withColumn("rank", F.row_number().over(best)))
    return apart.unionByName(above).withColumn("rank", F.col("rank").cast("int"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lc FROM t GROUP BY lang, term
         HAVING count(DISTINCT doc) >= 30),
grp AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT g.lang, g.source, k.term, k.lc, count(t.term) AS c
         FROM grp g JOIN kept k ON g.lang = k.lang
         LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term
         GROUP BY ALL),
tot AS (SELECT lang, source, sum(c) AS n, count(*) AS v, sum(lc) AS ln FROM cell GROUP BY ALL),
p AS (SELECT lang, source, term, c,
        1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (lc + 5)) // (ln + 5 * v)::HUGEINT AS q
      FROM cell JOIN tot USING (lang, source)),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
         GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source
                        AND dist.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p
          WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part
                                        ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
