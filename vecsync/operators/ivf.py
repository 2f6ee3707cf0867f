"""T5 with a stored index: an inverted file of vectors that later searches read in part.

``build`` writes the vectors once, one folder per cell (``cell=<n>``), each row with its
distance to the cell's centroid, and beside them one row per cell: centroid, group, number
of rows, least and largest distance.  Centroids have two levels: the centroids themselves
are clustered into groups, and a row is compared with the cells of its nearest ``GROUPS``
groups only, so placing a row costs about the square root of the number of cells.

``search`` prunes by the triangle inequality.  A row at distance r from the centroid of its
cell is at least |d(q, centroid) - r| away from a query q; a cell's least and largest r give
that bound for the whole cell.  The nearest cells of each query, until they hold ``k`` rows,
give a k-th distance; a cell whose bound is larger holds nothing better.  So

    exact=True   reads, beside those, all cells whose bound does not exceed it: the result is
                 that of the exact search;
    otherwise    the ``nprobe`` nearest cells among these.  ``nprobe`` is measured where it is
                 not given: at most ``PROBE_SAMPLE`` of the queries are searched exactly, in
                 the index, and as many cells are probed as ``recall`` of their neighbours need.

Cells that no query probes are never read: the probed ones are a partition filter of the
scan.  Inside a probed cell the same bound, per row, drops rows before any product is made.

Metrics: ``l2``, and ``cosine`` as L2 between unit vectors.  Rows without a distance (a NaN
component, another width, for cosine a zero vector) lie in cell -1 and are read only where
a query has fewer than ``k`` others; queries of that kind are answered from all cells.

Bounds: one row per cell (``MAX_CELLS`` at most) and a block of queries reach the driver; the
centroids are fitted on about ``knn.TRAIN_ROWS`` rows.
"""
from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .knn import (PROBE_SAMPLE, QUERY_BLOCK, SCORE_CELLS, _blocks, _cut_to_k, _metric_scores,
                  _Running, _squared, id_kind, train_cells)

MAX_CELLS = 16_384
GROUPS = 3
#: Rows that one task writes into a cell at most, so that a crowded cell is many files.
CELL_FILE_ROWS = 250_000
#: Bounds are compared with this much slack, relative to the lengths, for rounding.
SLACK = 1e-9


def _unit(rows: np.ndarray, metric: str) -> np.ndarray:
    """Vectors in the space whose L2 distance orders as ``metric`` does."""
    if metric == "l2":
        return rows
    norm = np.sqrt((rows * rows).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / norm[:, None]


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _grouped(spark: SparkSession, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of every centroid, and the groups' own centroids."""
    n = max(1, round(len(centers) ** 0.5))
    if len(centers) <= GROUPS * n:
        return np.zeros(len(centers), np.int64), centers.mean(axis=0, keepdims=True)
    rows = spark.createDataFrame([(c.tolist(),) for c in centers], "embedding array<double>")
    tops = train_cells(rows, n)
    return np.argmin(_squared(centers, tops), axis=1), tops


def _place(rows: np.ndarray, centers: np.ndarray, group: np.ndarray, tops: np.ndarray):
    """Cell and distance of every row: the nearest cell of its nearest groups."""
    near = np.argsort(_squared(rows, tops), axis=1, kind="stable")[:, :GROUPS]
    cell, far = np.full(len(rows), -1, np.int64), np.full(len(rows), np.inf)
    for g in np.unique(near):
        own, cells = np.flatnonzero((near == g).any(axis=1)), np.flatnonzero(group == g)
        if not len(cells):
            continue
        d = _squared(rows[own], centers[cells])
        best = np.argmin(d, axis=1)
        d = d[np.arange(len(own)), best]
        less = d < far[own]
        cell[own[less]], far[own[less]] = cells[best[less]], d[less]
    # not by the expansion: the bounds rest on this distance
    return cell, np.sqrt(((rows - centers[cell]) ** 2).sum(axis=1))


def build(corpus: DataFrame, path: str, metric: str = "l2", cells: int | None = None,
          id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> str:
    """Write the index of ``corpus`` to the new folder ``path`` (shared by all executors).

    ``cells`` defaults to the square root of the number of rows, ``MAX_CELLS`` at most.
    Rows without an id or a vector are left out: they are nobody's neighbours.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError("the triangle inequality needs l2 or cosine")
    spark = corpus.sparkSession
    _, kind, _ = id_kind(corpus, id_col)
    own = corpus.select(F.col(id_col).alias("id"),
                        F.col(vec_col).cast("array<double>").alias("vector"))
    own = own.filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
    widths = own.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w")
    first = widths.first()
    width, total = (first["w"], first["count"]) if first else (1, 0)
    plain = (F.size("vector") == width) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    if metric == "cosine":
        plain = plain & F.exists("vector", lambda x: x != 0)
    n = min(MAX_CELLS, cells or max(1, round(total ** 0.5)))
    sample = own.filter(plain)
    if metric == "cosine":
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
        sample = sample.withColumn("vector", F.transform("vector", lambda x: x / norm))
    centers = (train_cells(sample, n, "vector", seed) if total and not sample.isEmpty()
               else np.zeros((1, width)))
    group, tops = _grouped(spark, centers)
    sent = spark.sparkContext.broadcast((centers, group, tops))

    def place(batches):
        centers, group, tops = sent.value
        step = max(1, SCORE_CELLS // max(len(centers), 1))
        for pdf in batches:
            for lo in range(0, len(pdf), step):
                part = pdf.iloc[lo:lo + step].reset_index(drop=True)
                cell, far = np.full(len(part), -1), np.full(len(part), np.nan)
                ok = part["plain"].to_numpy(bool)
                if ok.any():
                    rows = _unit(_matrix(part["vector"][ok]), metric)
                    cell[ok], far[ok] = _place(rows, centers, group, tops)
                yield part[["id", "vector"]].assign(cell=cell, far=far)

    own_kind = own.schema["id"].dataType
    placed = own.select(F.col("id").cast(kind).alias("id"), "vector",
                        F.coalesce(plain, F.lit(False)).alias("plain")).mapInPandas(
        place, f"id {kind}, vector array<double>, cell int, far double")
    placed = placed.withColumn("id", F.col("id").cast(own_kind))
    # a cell is written by as many tasks as its share of the rows needs
    pieces = max(1, -(-total // (CELL_FILE_ROWS * n)))
    placed = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(pieces)))
    placed.write.partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/vectors")
    stats = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("least"),
                                       F.max("far").alias("most"))
    table = spark.createDataFrame([(i, int(g), c.tolist()) for i, (g, c)
                                   in enumerate(zip(group, centers))],
                                  "cell int, grp int, centroid array<double>")
    stats.join(table, "cell", "left").coalesce(1).write.parquet(f"{path}/cells")
    kind = StructType([*placed.schema.fields[:2], StructField("far", DoubleType()),
                       StructField("cell", IntegerType())]).json()
    (spark.createDataFrame([(metric, width, kind)], "metric string, width int, kind string")
     .coalesce(1).write.parquet(f"{path}/shape"))
    return path


class Index:
    """An index as written: the cells (in the driver) and the vectors (on disk)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.metric, self.width, kind = spark.read.parquet(f"{path}/shape").first()
        kind = StructType.fromJson(json.loads(kind))
        self.vectors = spark.read.schema(kind).parquet(f"{path}/vectors")
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        self.odd = sum(r["n"] for r in rows if r["cell"] < 0)
        rows = [r for r in rows if r["cell"] >= 0]
        self.cell = np.array([r["cell"] for r in rows], dtype=np.int64)
        self.n = np.array([r["n"] for r in rows], dtype=np.int64)
        self.least = np.array([r["least"] for r in rows])
        self.most = np.array([r["most"] for r in rows])
        self.centers = (_matrix([r["centroid"] for r in rows]) if rows
                        else np.zeros((0, self.width)))
        self.id_type = self.vectors.schema["id"].dataType

    def read(self, cells: np.ndarray) -> DataFrame:
        """The rows of the given cells; the scan opens their folders only."""
        return self.vectors.filter(F.col("cell").isin([int(c) for c in cells]))

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Of every query to every centroid, in the index's space."""
        return np.sqrt(np.maximum(_squared(_unit(queries, self.metric), self.centers), 0.0))

    def bounds(self, far: np.ndarray) -> np.ndarray:
        """What every row of a cell is away from a query at least."""
        return np.maximum(0.0, np.maximum(far - self.most[None, :], self.least[None, :] - far))

    def threshold(self, score: np.ndarray) -> np.ndarray:
        """Scores as distances in the index's space, slightly enlarged."""
        if self.metric == "l2":
            return score * (1 + SLACK) + 1e-6
        return np.sqrt(np.maximum(2.0 * score, 0.0)) * (1 + SLACK) + 1e-6


def _near(r: np.ndarray, away: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """Which rows, at ``r`` from their centroid, some query that is ``away`` from it can have
    within its limit; rows times queries are held for ``step`` rows at a time."""
    out = np.zeros(len(r), bool)
    for lo in range(0, len(r), step):
        gap = np.abs(away[None, :] - r[lo:lo + step, None])
        out[lo:lo + step] = (~(gap > limit[None, :])).any(axis=1)
    return out


def _probe(index: Index, block, asks: np.ndarray, k: int, limit: np.ndarray | None,
           odd: bool, qid_col: str, id_col: str) -> DataFrame:
    """Candidates of the queries of a block in the cells that each asks for (``asks``, queries
    × cells); rows beyond a query's ``limit`` by their own bound are not looked at."""
    ids_q, mat = block
    own = np.flatnonzero(asks.any(axis=0))
    number = {int(index.cell[c]): j for j, c in enumerate(own)}
    far = index.distances(mat)[:, own]
    sent = index.spark.sparkContext.broadcast((ids_q, mat, number, asks[:, own], far, limit))
    metric = index.metric
    numpy_kind, kind, _ = id_kind(index.vectors, "id")
    query_kind = "string" if ids_q.dtype == object else "long"

    def run(batches):
        ids_q, mat, number, asks, far, limit = sent.value
        qnorm = np.sqrt((mat * mat).sum(axis=1))
        best, step = _Running(k, numpy_kind), max(1, SCORE_CELLS // len(ids_q))
        for pdf in batches:
            for cell, at in pdf.groupby("cell").indices.items():
                which = (np.arange(len(ids_q)) if cell < 0
                         else np.flatnonzero(asks[:, number[int(cell)]]))
                ids = pdf["id"].to_numpy()[at].astype(numpy_kind)
                vectors = pdf["vector"].to_numpy()[at]
                if cell < 0:
                    for q in which:            # no distance to any: NaN for every query
                        best.add(ids, which[[q]], np.full((len(ids), 1), np.nan))
                    continue
                if limit is not None:
                    away, most = far[which, number[int(cell)]], limit[which]
                    r = pdf["far"].to_numpy()[at]
                    near = _near(r, away, most, step)
                    ids, vectors = ids[near], vectors[near]
                for lo in range(0, len(ids), step):
                    score = _metric_scores(_matrix(vectors[lo:lo + step]), mat[which], metric,
                                           qnorm[which])
                    best.add(ids[lo:lo + step], which, score)
        if len(best.q):
            yield pd.DataFrame({qid_col: ids_q[best.q], id_col: best.id, "score": best.s})

    cells = np.append(index.cell[own], -1) if odd else index.cell[own]
    src = index.read(cells).select(F.col("id").cast(kind).alias("id"), "vector", "cell", "far")
    return src.mapInPandas(run, f"{qid_col} {query_kind}, {id_col} {kind}, score double")


def _first_cells(index: Index, far: np.ndarray, k: int) -> np.ndarray:
    """Queries × cells: each query's nearest cells until they hold ``k`` rows."""
    order = np.argsort(far, axis=1, kind="stable")
    before = np.cumsum(index.n[order], axis=1) - index.n[order]
    asks = np.zeros(far.shape, bool)
    np.put_along_axis(asks, order, before < k, axis=1)
    return asks


def _nearest_cells(far: np.ndarray, n: int) -> np.ndarray:
    asks = np.zeros(far.shape, bool)
    np.put_along_axis(asks, np.argsort(far, axis=1, kind="stable")[:, :n], True, axis=1)
    return asks


def _exact_asks(index: Index, block, k: int, qid_col: str, id_col: str, kinds: tuple):
    """The cells that can hold one of a query's ``k`` nearest, and its limit."""
    ids_q, mat = block
    far = index.distances(mat)
    limit = np.full(len(ids_q), np.inf)
    if far.shape[1]:
        found = _cut_to_k([_probe(index, block, _first_cells(index, far, k), k, None, False,
                                  qid_col, id_col)], index.spark, k, qid_col, id_col, kinds)
        at = {q: i for i, q in enumerate(ids_q.tolist())}
        # one row per query
        for r in found.filter(F.col("rank") == k).select(qid_col, "score").collect():
            limit[at[r[0]]] = r["score"]
    limit = index.threshold(np.where(np.isnan(limit), np.inf, limit))
    return ~(index.bounds(far) > limit[:, None]), limit


def search(index: Index, queries: DataFrame, k: int, nprobe: int | None = None,
           exact: bool = False, recall: float = 0.95, qid_col: str = "query_id",
           qvec_col: str = "query_vector", id_col: str = "vec_id",
           query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` nearest rows per query: (query_id, rank, id, score), from probed cells only."""
    spark = index.spark
    numpy_kind, kind, own = id_kind(queries, qid_col)
    kinds = (spark.createDataFrame([], f"q {kind}").schema[0].dataType, index.id_type)
    cand = []
    for block in _blocks(queries, qid_col, qvec_col, query_block):
        ids_q, mat = block
        if mat.shape[1] != index.width and len(index.cell):
            raise ValueError(f"queries of width {mat.shape[1]}, index of width {index.width}")
        far = index.distances(mat)
        none = np.isnan(far).any(axis=1)
        odd = index.odd > 0 and (int(index.n.sum()) < k or bool(none.any()))
        if exact:
            asks, limit = _exact_asks(index, block, k, qid_col, id_col, kinds)
            cand.append(_probe(index, block, asks, k, limit, odd, qid_col, id_col))
            continue
        if nprobe is None:
            nprobe = _measured(index, block, far, k, recall, qid_col, id_col, kinds)
        asks = _nearest_cells(far, nprobe) | none[:, None]
        cand.append(_probe(index, block, asks, k, None, odd, qid_col, id_col))
    return _cut_to_k(cand, spark, k, qid_col, id_col, (own, index.id_type))


def _measured(index: Index, block, far: np.ndarray, k: int, recall: float, qid_col: str,
              id_col: str, kinds: tuple) -> int:
    """The number of nearest cells in which a sample of the queries has at least ``recall`` of
    its exact neighbours."""
    ids_q, mat = block
    some = np.argsort(ids_q, kind="stable")
    some = some[np.random.default_rng(7).permutation(len(some))[:PROBE_SAMPLE]]
    part = ids_q[some], mat[some]
    asks, limit = _exact_asks(index, part, k, qid_col, id_col, kinds)
    found = _cut_to_k([_probe(index, part, asks, k, limit, False, qid_col, id_col)],
                      index.spark, k, qid_col, id_col, kinds)
    # at most k cells per sampled query reach the driver
    near = found.join(index.read(index.cell[asks.any(axis=0)])
                      .select(F.col("id").alias(id_col), "cell"), id_col)
    near = near.select(qid_col, "cell").collect()
    if not near:
        return len(index.cell)
    rank = np.argsort(np.argsort(far[some], axis=1, kind="stable"), axis=1, kind="stable")
    row = {q: i for i, q in enumerate(part[0].tolist())}
    column = {c: j for j, c in enumerate(index.cell.tolist())}
    need = np.sort([rank[row[q], column[c]] + 1 for q, c in near])
    return int(need[max(0, int(np.ceil(recall * len(need))) - 1)])
