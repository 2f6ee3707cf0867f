"""Ranked lexical search with per-term geometric blocking.

The whole table is indexed for the terms of a set of queries (sets of terms), in Spark steps
that are each written once:

    postings   every document's query terms with frequencies, its length   (one scan of texts)
    vectors    the impact of each of them, and the document's place among bounded sample
               documents: its nearest, second and third nearest by weighted inner product
    cells      documents in order of that place, some thousand to a row
    blocks     in each cell, the posting list of a term is cut in that order, so that a block
               holds like documents; beside it stands its summary, the largest impact that
               each coordinate has in the block

A document counts for a query in the list of its rarest query term (the first by weight), so
the list of a term needs the coordinates of that term and of commoner ones only.  The bound
of a block for a query, the sum of weight times summary over those coordinates, is exact: no
document that counts there scores above it.  First the blocks with the highest bounds are
scored and give each query a k-th best score; then every block whose bound reaches it is
scored.  A block is skipped only when its bound stays below.  The result does not depend on
the sample, the cells or the block length.

Defined results
    null and empty text      no terms: neither counted in N nor found
    item without terms       no rows
    null item or document    an item like any other; null doc_ids come last among ties
    ties                     ascending doc_id, then an arbitrary order of equal rows
    repeated documents       each is a document, and each may be ranked
    repeated items           rows of one item_id are one item with the terms of all
    very long texts          whole
    empty tables             empty result
    extra columns            ignored, whatever their names
Bounds: queries are worked off in groups of about ``QUERY_TERMS`` (item, term) pairs, which
are what is collected and sent to tasks, with ``PLACES`` sample documents; of the documents
one frequency per query term reaches the driver.
"""
from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from vecsync.llm.common import col, materialise, slices

#: Bytes of terms (digits, letters, and all of other scripts), A-Z lower, the rest blank.
TERM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90
             else 32 for c in range(256))
QUERY_TERMS = 1 << 15
PLACES, CELL_DOCS, CELL_POSTINGS, BLOCK_DOCS, FIRST_BLOCKS = 256, 4096, 1 << 19, 64, 8
#: Documents times terms of a cell, as a task spreads it out (4 bytes each).
CELL_ROOM = 1 << 24


def _terms(text) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM).split()


def query_groups(queries: DataFrame, id_col: str, text_col: str):
    """The items' distinct (item, term) pairs, some ``QUERY_TERMS`` at a time."""
    src = queries.select(col(id_col).cast("string").alias("item"),
                         col(text_col).cast("string").alias("text"))

    def run(batches):
        for pdf in slices(batches, "text"):
            out = [(i, t) for i, text in zip(pdf["item"], pdf["text"]) for t in set(_terms(text))]
            yield pd.DataFrame(out, columns=["item", "term"])

    pairs = materialise(src.mapInPandas(run, "item string, term binary").distinct(), "queries")
    groups = math.ceil(pairs.count() / QUERY_TERMS)
    for g in range(groups):
        rows = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).collect()
        if rows:
            yield [(r["item"], bytes(r["term"])) for r in rows]


def postings(docs: DataFrame, place: dict, id_col: str, text_col: str) -> DataFrame:
    """doc_id (as text), row (unique), n, terms and tfs of every document with a term; terms
    by their numbers in ``place``."""
    src = docs.select(col(id_col).cast("string").alias("doc_id"),
                      col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches):
        known, row = sent.value, TaskContext.get().partitionId() << 36
        for pdf in slices(batches, "text"):
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                every = _terms(text)
                if every:
                    tf = Counter(t for t in every if t in known)
                    out.append((doc, row, len(every), [known[t] for t in tf], list(tf.values())))
                row += 1
            yield pd.DataFrame(out, columns=["doc_id", "row", "n", "terms", "tfs"])

    return src.mapInPandas(run, "doc_id string, row long, n long, terms array<int>, "
                                "tfs array<int>")


class Ranking:
    """What tasks know of a group of queries: weights and ranks of the terms, the items that
    hold each term, and the items' terms in rank order (rarest first)."""

    def __init__(self, items: list, frequency: np.ndarray, documents: int, total: int):
        self.documents, self.total = documents, total
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(f) + 1)))
                                for f in frequency], dtype=np.int64)
        self.rank = np.empty(len(frequency), dtype=np.int64)
        self.rank[np.lexsort((np.arange(len(frequency)), -self.weight))] = range(len(frequency))
        self.items = [np.array(sorted(terms, key=lambda t: self.rank[t]), dtype=np.int64)
                      for terms in items]
        holders = defaultdict(list)
        for q, terms in enumerate(self.items):
            for i, t in enumerate(terms.tolist()):
                holders[t].append((q, i))
        self.lists = {}          # term -> coordinates, items, weights (coordinate x item)
        for t, qs in holders.items():
            tails = [self.items[q][i:] for q, i in qs]
            coords = np.unique(np.concatenate(tails))
            table = np.zeros((len(coords), len(qs)), dtype=np.int64)
            for j, tail in enumerate(tails):
                table[np.searchsorted(coords, tail), j] = self.weight[tail]
            self.lists[t] = coords, np.array([q for q, _ in qs]), table

    def impacts(self, n: int, tfs: np.ndarray) -> np.ndarray:
        m = 10 + 90 * n * self.documents // self.total
        return 1_000_000_000 * tfs // (1000 * tfs + 8 * m)


def _flat(rows) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and the values of a column of arrays, end to end."""
    sizes = np.array([len(x) for x in rows], dtype=np.int64)
    return sizes, (np.concatenate([np.asarray(x, dtype=np.int64) for x in rows])
                   if sizes.sum() else np.zeros(0, np.int64))


def vectors(found: DataFrame, ranking, samples: list) -> DataFrame:
    """Impacts of every document with a query term, and ``near``: the numbers of the three
    sample documents nearest to it, as one number."""
    sent = found.sparkSession.sparkContext.broadcast((ranking, samples))

    def run(batches):
        rank, sample = sent.value
        table = np.zeros((len(rank.weight), max(3, len(sample))), dtype=np.float32)
        for j, (n, terms, tfs) in enumerate(sample):
            x = rank.weight[terms] * rank.impacts(n, np.array(tfs, dtype=np.int64)).astype(float)
            table[terms, j] = x / max(1.0, math.sqrt((x * x).sum()))
        for pdf in batches:
            impacts, near = [], []
            for n, terms, tfs in zip(pdf["n"].tolist(), pdf["terms"], pdf["tfs"]):
                x = rank.impacts(n, tfs.astype(np.int64))
                like = (rank.weight[terms] * x).astype(np.float32) @ table[terms]
                best = np.argpartition(-like, 2)[:3]
                a, b, c = best[np.lexsort((best, -like[best]))].tolist()
                impacts.append(x.astype(np.int32))
                near.append((a << 40) | (b << 20) | c)
            yield pdf[["doc_id", "row", "terms"]].assign(impacts=impacts, near=near)

    return found.filter(F.size("terms") > 0).mapInPandas(
        run, "doc_id string, row long, terms array<int>, impacts array<int>, near long")


def cells(placed: DataFrame, terms: int) -> DataFrame:
    """Rows of up to ``CELL_DOCS`` documents and about ``CELL_POSTINGS`` postings, in order of
    their place: cell, ids, rows, sizes, terms, impacts (end to end)."""
    most = max(1, min(CELL_DOCS, CELL_ROOM // max(1, terms)))

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out():
            pdf = pd.DataFrame(held, columns=["doc_id", "row", "terms", "impacts"])
            sizes, terms = _flat(pdf["terms"])
            return pd.DataFrame({"cell": [number], "ids": [pdf["doc_id"].tolist()],
                                 "rows": [pdf["row"].tolist()], "sizes": [sizes],
                                 "terms": [terms], "impacts": [_flat(pdf["impacts"])[1]]})

        for pdf in batches:
            for r in zip(pdf["doc_id"], pdf["row"], pdf["terms"], pdf["impacts"]):
                held.append(r)
                size += len(r[2])
                if len(held) >= most or size >= CELL_POSTINGS:
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    order = placed.select("doc_id", "row", "terms", "impacts", "near")
    return (order.repartitionByRange("near", "row").sortWithinPartitions("near", "row")
            .drop("near")
            .mapInPandas(run, "cell long, ids array<string>, rows array<long>, "
                              "sizes array<int>, terms array<int>, impacts array<int>"))


def _one_cell(sizes, terms, impacts):
    """(document, term, impact) of a cell's postings, by document."""
    doc = np.repeat(np.arange(len(sizes)), np.asarray(sizes, dtype=np.int64))
    return doc, np.asarray(terms, dtype=np.int64), np.asarray(impacts, dtype=np.int64)


def blocks(index: DataFrame, ranking) -> DataFrame:
    """The blocks of every posting list: cell, term, docs (places in the cell), summary (the
    largest impacts in the order of the list's coordinates)."""
    sent = index.sparkSession.sparkContext.broadcast(ranking)

    def run(batches):
        rank = sent.value
        for pdf in batches:
            for cell, sizes, terms, impacts in zip(pdf["cell"], pdf["sizes"], pdf["terms"],
                                                   pdf["impacts"]):
                doc, term, impact = _one_cell(sizes, terms, impacts)
                table = np.zeros((len(rank.weight), len(sizes)), dtype=np.int32)
                table[term, doc] = impact
                out = []
                for t in np.unique(term).tolist():
                    coords = rank.lists[t][0]
                    docs = np.flatnonzero(table[t])
                    starts = np.arange(0, len(docs), BLOCK_DOCS)
                    top = np.maximum.reduceat(table[np.ix_(coords, docs)], starts, axis=1)
                    for j, s in enumerate(starts.tolist()):
                        out.append((cell, t, docs[s:s + BLOCK_DOCS], top[:, j]))
                yield pd.DataFrame(out, columns=["cell", "term", "docs", "summary"])

    return index.select("cell", "sizes", "terms", "impacts").mapInPandas(
        run, "cell long, term int, docs array<int>, summary array<int>")


def _bounds(pdf: pd.DataFrame, rank, low: np.ndarray):
    """Rows of ``pdf``, items and bounds of the blocks whose bound is at least ``low`` (by
    item), term by term."""
    rows, items, bounds = [], [], []
    summary = pdf["summary"].to_numpy()
    for t, at in pdf.groupby("term").indices.items():
        _, own, table = rank.lists[int(t)]
        bound = np.stack(summary[at]).astype(np.int64) @ table
        r, c = np.nonzero(bound >= low[own])
        if len(r):
            rows.append(at[r])
            items.append(own[c])
            bounds.append(bound[r, c])
    none = [np.zeros(0, np.int64)]
    return [np.concatenate(x or none) for x in (rows, items, bounds)]


def _highest(item: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Places of the ``FIRST_BLOCKS`` highest bounds of each item."""
    order = np.lexsort((-bound, item))
    start = np.flatnonzero(np.r_[True, np.diff(item[order]) != 0][:len(order)])
    size = np.diff(np.r_[start, len(order)])
    return order[np.arange(len(order)) - np.repeat(start, size) < FIRST_BLOCKS]


def open_blocks(stored: DataFrame, ranking, least: list | None = None) -> DataFrame:
    """cell, item, docs of the blocks whose bound is above 0 and at least the item's ``least``;
    without it, those of the ``FIRST_BLOCKS`` highest bounds of each item."""
    sent = stored.sparkSession.sparkContext.broadcast((ranking, least))
    columns = ["cell", "item", "docs", "bound"]

    def every(batches):
        rank, low = sent.value
        low = np.maximum(np.array(low, dtype=np.int64), 1)
        for pdf in batches:
            at, item, bound = _bounds(pdf, rank, low)
            yield pd.DataFrame(dict(zip(columns, (
                pdf["cell"].to_numpy()[at], item, pdf["docs"].to_numpy()[at], bound))))

    def highest(batches):
        rank, _ = sent.value
        low = np.ones(len(rank.items), dtype=np.int64)
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object),
                np.zeros(0, np.int64)]
        for pdf in batches:
            at, item, bound = _bounds(pdf, rank, low)
            new = pdf["cell"].to_numpy()[at], item, pdf["docs"].to_numpy()[at], bound
            best = [np.concatenate(x) for x in zip(best, new)]
            keep = _highest(best[1], best[3])
            best = [x[keep] for x in best]
            full = np.bincount(best[1], minlength=len(low)) >= FIRST_BLOCKS
            lowest = np.full(len(low), np.iinfo(np.int64).max)
            np.minimum.at(lowest, best[1], best[3])
            low[full] = lowest[full]
        yield pd.DataFrame(dict(zip(columns, best)))

    schema = "cell long, item int, docs array<int>, bound long"
    if least is not None:
        return stored.mapInPandas(every, schema)
    top = Window.partitionBy("item").orderBy(F.desc("bound"), "cell", "docs")
    return (stored.mapInPandas(highest, schema).withColumn("at", F.row_number().over(top))
            .filter(F.col("at") <= FIRST_BLOCKS).drop("at"))


def scored(opened: DataFrame, index: DataFrame, ranking, k: int, kind,
           least: list | None = None) -> DataFrame:
    """The exact scores of the documents of ``opened`` blocks: item, doc_id, row, score, the k
    best of each item and cell, of those that reach the item's ``least``.  A cell meets its
    blocks in a join.  ``kind``: the identifiers' type; equal scores are cut here where it is a
    whole number or text."""
    number = {True: int, False: str}[isinstance(kind, IntegralType)]
    orders = isinstance(kind, (IntegralType, StringType))
    sent = opened.sparkSession.sparkContext.broadcast((ranking, least))
    met = (opened.groupBy("cell", "item").agg(F.array_distinct(F.flatten(F.collect_list("docs")))
                                              .alias("docs"))
           .groupBy("cell").agg(F.collect_list(F.struct("item", "docs")).alias("asked"))
           .join(index, "cell"))

    def run(batches):
        rank, low = sent.value
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                doc, term, impact = _one_cell(r.sizes, r.terms, r.impacts)
                table = np.zeros((len(r.sizes), len(rank.weight)), dtype=np.int32)
                table[doc, term] = impact
                out = []
                for a in r.asked:
                    item, docs = a["item"], np.asarray(a["docs"], dtype=np.int64)
                    terms = rank.items[item]
                    score = table[np.ix_(docs, terms)].astype(np.int64) @ rank.weight[terms]
                    some = pd.DataFrame({"item": item, "doc_id": np.asarray(r.ids, object)[docs],
                                         "row": np.asarray(r.rows)[docs], "score": score})
                    some = some[some["score"] >= max(1, low[item] if low else 1)]
                    if len(some) > k:           # the k-th best and all its ties
                        some = some[some["score"] >= np.partition(some["score"], -k)[-k]]
                    if len(some) > k and orders:
                        key = [(-s, i is None, number(i or 0), w) for i, w, s in
                               zip(some["doc_id"], some["row"], some["score"])]
                        some = some.iloc[sorted(range(len(key)), key=key.__getitem__)[:k]]
                    out.append(some)
                yield pd.concat(out)

    return met.select("cell", "ids", "rows", "sizes", "terms", "impacts", "asked").mapInPandas(
        run, "item int, doc_id string, row long, score long")


def _best(found: DataFrame, kind, k: int) -> DataFrame:
    found = found.withColumn("doc_id", F.col("doc_id").cast(kind))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(),
                                               "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id", query_col: str = "text"
           ) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents with a score above 0 of each
    item of ``queries``."""
    spark = docs.sparkSession
    kind = docs.select(col(id_col)).schema[0].dataType
    item_kind = queries.select(col(item_col)).schema[0].dataType
    none = spark.createDataFrame([], "item_id string, rank int, doc_id string, score long")
    done = []
    for pairs in query_groups(queries, item_col, query_col):
        place = {t: i for i, t in enumerate(sorted({t for _, t in pairs}))}
        by = defaultdict(set)
        for item, t in pairs:
            by[item].add(place[t])
        names = list(by)
        found = materialise(postings(docs, place, id_col, text_col), "postings")
        n, total = found.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n:
            continue
        frequency = np.zeros(len(place), dtype=np.int64)
        for t, f in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            frequency[t] = f
        ranking = Ranking(list(by.values()), frequency, n, total)
        sample = [(r["n"], r["terms"], r["tfs"]) for r in
                  found.filter(F.size("terms") > 0).orderBy(F.xxhash64("row"), "row")
                  .limit(PLACES).collect()]
        placed = materialise(vectors(found, ranking, sample), "vectors")
        index = materialise(cells(placed, len(place)), "cells")
        stored = materialise(blocks(index, ranking), "blocks")
        first = _best(scored(open_blocks(stored, ranking), index, ranking, k, kind), kind,
                      k)
        least = [0] * len(names)
        for item, score in (first.filter(F.col("rank") == k).select("item", "score").collect()):
            least[item] = score
        best = _best(scored(open_blocks(stored, ranking, least), index, ranking, k, kind, least),
                     kind, k)
        labels = spark.createDataFrame(list(enumerate(names)), "item int, item_id string")
        best = best.join(F.broadcast(labels), "item")        # at most QUERY_TERMS items
        done.append(best.select("item_id", F.col("rank").cast("int").alias("rank"),
                                F.col("doc_id").cast("string").alias("doc_id"), "score"))
    for more in done:
        none = none.unionByName(more)
    return (none.withColumn("item_id", F.col("item_id").cast(item_kind))
            .withColumn("doc_id", F.col("doc_id").cast(kind)))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf
       FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM tf, s GROUP BY term, docs),
m AS (SELECT doc_id, 10 + (90 * len(terms) * docs) // total AS m FROM d, s WHERE len(terms) > 0),
r AS (SELECT item_id, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""
