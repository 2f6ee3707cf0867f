"""T4 exact k-NN, T5 IVF k-NN, F19 dimension migration plan.

T4: the query set is worked off in blocks of at most ``QUERY_BLOCK`` queries,
each shipped to executors as one broadcast matrix.  Each task scores its
corpus batches against the block with one BLAS matrix product and keeps a
running top-``k`` per query (total order: a number before NaN, score, id;
ids of any type, other than whole numbers as text), so at most ``k × tasks`` candidates per query reach the shuffle; a
``row_number() <= k`` window (WindowGroupLimit) per query then gives the
exact answer.  No join operator, no all-pairs output.

T5: k-means cells (``pyspark.ml``, fitted on a bounded sample) as the coarse
quantiser, about the square root of the corpus size in number.  Each query
probes its ``nprobe`` nearest cells; a task finds the cell of each of its
corpus rows, scores a cell's rows only against the queries that probe the
cell (matrix products again) and keeps the same running top-``k``.  Every
row is searched, whatever the size of its cell.  How many cells a wanted
recall needs depends on corpus and queries, so it is measured: at most
``PROBE_SAMPLE`` queries are searched exactly.
"""
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegralType, LongType, StringType, StructField,
                               StructType)

from ..functions.vectors import vsize
from ..session import checkpoint_dir

QUERY_BLOCK = 4096
TRAIN_ROWS = 100_000
PROBE_SAMPLE = 256
# upper bound of one in-task score matrix (rows × queries or rows × centroids)
SCORE_CELLS = 4_000_000


def _metric_scores(block: np.ndarray, queries: np.ndarray, metric: str,
                   qnorm: np.ndarray) -> np.ndarray:
    """(batch × Q) distance-like scores, smaller is closer."""
    ip = block @ queries.T
    if metric == "ip":
        return -ip
    if metric == "l2":
        bn = (block * block).sum(axis=1)[:, None]
        return np.sqrt(np.maximum(bn + (qnorm ** 2)[None, :] - 2.0 * ip, 0.0))
    if metric == "cosine":
        bn = np.sqrt((block * block).sum(axis=1))[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):    # zero vectors: NaN
            return 1.0 - ip / (bn * qnorm[None, :])
    raise ValueError(metric)


def _top_k(qi: np.ndarray, ids: np.ndarray, sc: np.ndarray, k: int):
    """Per query the ``k`` smallest by the total order (NaN last, score, id)."""
    by = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
    order = np.lexsort((by, sc, np.isnan(sc), qi))
    qi, ids, sc = qi[order], ids[order], sc[order]
    starts = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
    sizes = np.diff(np.r_[starts, len(qi)])
    rank = np.arange(len(qi)) - np.repeat(starts, sizes)
    keep = rank < k
    return qi[keep], ids[keep], sc[keep]


class _Running:
    """Running top-``k`` per query of a block."""

    def __init__(self, k: int, ids=np.int64):
        self.k = k
        self.q, self.id, self.s = np.empty(0, np.int64), np.empty(0, ids), np.empty(0)

    def add(self, ids: np.ndarray, queries: np.ndarray, sc: np.ndarray) -> None:
        """Scores of rows (ids) × queries (their numbers): per query the rows at or below its
        k-th score (ties kept; NaN counts as the largest) go on."""
        kk = min(self.k, len(ids))
        filled = np.where(np.isnan(sc), np.inf, sc)
        cut = np.partition(filled, kk - 1, axis=0)[kk - 1]
        rows, cols = np.nonzero(filled <= cut[None, :])
        self.q, self.id, self.s = _top_k(np.r_[self.q, queries[cols]], np.r_[self.id, ids[rows]],
                                         np.r_[self.s, sc[rows, cols]], self.k)


def id_kind(df: DataFrame, name: str) -> tuple:
    """How ids travel through Python (numpy and Spark type), and the column's own type."""
    own = df.schema[name].dataType
    return (np.int64, "long", own) if isinstance(own, IntegralType) else (object, "string", own)


def _blocks(queries: DataFrame, qid_col: str, qvec_col: str, block: int):
    """(ids, matrix) of the query set, about ``block`` queries at a time; a query without an
    id or a vector asks nothing."""
    checkpoint_dir(queries.sparkSession)
    numpy_kind, kind, _ = id_kind(queries, qid_col)
    q = (queries.select(F.col(qid_col).cast(kind).alias(qid_col), qvec_col)
         .filter(F.col(qvec_col).isNotNull() & F.col(qid_col).isNotNull()).checkpoint())
    n = -(-q.count() // block)
    for b in range(n):
        rows = q.filter(F.pmod(F.xxhash64(qid_col), F.lit(n)) == b).collect()
        if rows:
            yield (np.array([r[0] for r in rows], dtype=numpy_kind),
                   np.array([np.asarray(r[1], dtype=np.float64) for r in rows]))


def _cut_to_k(cand: list[DataFrame], spark: SparkSession, k: int, qid_col: str, id_col: str,
              kinds: tuple) -> DataFrame:
    """The ``k`` best candidates of every query, ids in their own types (``kinds``)."""
    every = spark.createDataFrame([], StructType([
        StructField(qid_col, kinds[0]), StructField(id_col, kinds[1]),
        StructField("score", DoubleType())]))
    for c in cand:
        # pandas hands NaN over as null
        every = every.unionByName(c.select(
            F.col(qid_col).cast(kinds[0]).alias(qid_col), F.col(id_col).cast(kinds[1])
            .alias(id_col), F.coalesce("score", F.lit(float("nan"))).alias("score")))
    w = Window.partitionBy(qid_col).orderBy(F.col("score"), F.col(id_col))
    return (every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                 .select(qid_col, "rank", id_col, "score"))


def _search(spark: SparkSession, corpus: DataFrame, block, k: int, metric: str, id_col: str,
            vec_col: str, qid_col: str, centers: np.ndarray | None = None,
            nprobe: int = 0) -> DataFrame:
    """Candidates of one block of queries: of all rows, or of the cells that they probe."""
    ids_q, mat = block
    probe = _cells(mat, centers, nprobe) if centers is not None else None
    sent = spark.sparkContext.broadcast((ids_q, mat, centers, probe))
    numpy_kind, kind, _ = id_kind(corpus, id_col)
    query_kind = "string" if ids_q.dtype == object else "long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_q, mat, centers, probe = sent.value
        qnorm = np.sqrt((mat * mat).sum(axis=1))
        best = _Running(k, numpy_kind)
        everyone = np.arange(len(ids_q))
        step = max(1, SCORE_CELLS // len(ids_q))   # rows × queries per score matrix
        for pdf in batches:
            pdf = pdf[pdf[vec_col].notna()]
            all_ids = pdf[id_col].to_numpy().astype(numpy_kind)
            vecs = pdf[vec_col].to_numpy()
            for lo in range(0, len(pdf), step):
                rows = np.stack([np.asarray(v, dtype=np.float64) for v in vecs[lo:lo + step]])
                ids = all_ids[lo:lo + step]
                if centers is None:
                    best.add(ids, everyone, _metric_scores(rows, mat, metric, qnorm))
                    continue
                cell = _nearest(rows, centers)
                for c in np.unique(cell):
                    own, asks = cell == c, np.flatnonzero((probe == c).any(axis=1))
                    if len(asks):
                        best.add(ids[own], asks, _metric_scores(rows[own], mat[asks], metric,
                                                                qnorm[asks]))
        if len(best.q):
            yield pd.DataFrame({qid_col: ids_q[best.q], id_col: best.id, "score": best.s})

    src = corpus.select(F.col(id_col).cast(kind).alias(id_col), vec_col)
    return src.filter(F.col(id_col).isNotNull()).mapInPandas(
        run, f"{qid_col} {query_kind}, {id_col} {kind}, score double")


def knn_exact(spark: SparkSession, corpus: DataFrame, queries: DataFrame, k: int,
              metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding",
              qid_col: str = "query_id", qvec_col: str = "query_vector",
              query_block: int = QUERY_BLOCK) -> DataFrame:
    """T4: exact top-``k`` corpus rows per query: (query_id, rank, id, score).

    A NaN score (cosine with a zero vector) ranks after all numbers.  Rows without an id or
    a vector are nobody's neighbours.  The corpus is read once for each ``query_block``.
    """
    cand = [_search(spark, corpus, block, k, metric, id_col, vec_col, qid_col)
            for block in _blocks(queries, qid_col, qvec_col, query_block)]
    return _cut_to_k(cand, spark, k, qid_col, id_col,
                     (queries.schema[qid_col].dataType, corpus.schema[id_col].dataType))


def train_cells(corpus: DataFrame, nlist: int, vec_col: str = "embedding", seed: int = 7,
                max_iter: int = 20, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Fit k-means centroids (the IVF coarse quantiser) on about ``train_rows`` rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    have = corpus.filter(F.col(vec_col).isNotNull())
    n = have.count()
    if n > train_rows:
        have = have.sample(train_rows / n, seed=seed)
    feats = have.select(array_to_vector(F.col(vec_col)).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="features").fit(feats)
    return np.stack([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])


def _squared(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared L2 via the BLAS expansion: memory rows × centroids only."""
    return ((rows * rows).sum(axis=1)[:, None] + (centers * centers).sum(axis=1)[None, :]
            - 2.0 * (rows @ centers.T))


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest cell of every row."""
    return np.argmin(_squared(rows, centers), axis=1)


def _cells(rows: np.ndarray, centers: np.ndarray, nprobe: int) -> np.ndarray:
    """The ``nprobe`` nearest cells of every row, nearest first."""
    return np.argsort(_squared(rows, centers), axis=1, kind="stable")[:, :nprobe]


def _probes_for(spark: SparkSession, corpus: DataFrame, block, k: int, metric: str, id_col: str,
                vec_col: str, qid_col: str, centers: np.ndarray, recall: float) -> int:
    """The number of nearest cells in which a sample of the block's queries has at least
    ``recall`` of its exact neighbours."""
    ids_q, mat = block
    by_id = np.argsort(ids_q, kind="stable")
    some = by_id[np.random.default_rng(7).permutation(len(by_id))[:PROBE_SAMPLE]]
    ids_q, mat = ids_q[some], mat[some]
    found = _search(spark, corpus, (ids_q, mat), k, metric, id_col, vec_col, qid_col)
    # at most k rows per sampled query reach the driver
    near = (_cut_to_k([found], spark, k, qid_col, id_col,
                      (StringType() if ids_q.dtype == object else LongType(),
                       corpus.schema[id_col].dataType)).select(qid_col, id_col)
            .join(corpus.select(id_col, vec_col), id_col).select(qid_col, vec_col).collect())
    if not near:
        return len(centers)
    row = {q: i for i, q in enumerate(ids_q.tolist())}
    rank = np.argsort(_cells(mat, centers, len(centers)), axis=1, kind="stable")
    own = _nearest(np.array([np.asarray(r[1], dtype=np.float64) for r in near]), centers)
    need = np.sort(rank[[row[r[0]] for r in near], own]) + 1
    return int(need[max(0, int(np.ceil(recall * len(need))) - 1)])


def knn_ivf(spark: SparkSession, corpus: DataFrame, queries: DataFrame, k: int,
            nlist: int | None = None, nprobe: int | None = None, metric: str = "l2",
            id_col: str = "vec_id", vec_col: str = "embedding", qid_col: str = "query_id",
            qvec_col: str = "query_vector", query_block: int = QUERY_BLOCK,
            recall: float = 0.95) -> DataFrame:
    """T5: approximate top-``k`` via ``nprobe`` of ``nlist`` k-means cells.

    ``nlist`` defaults to the square root of the corpus size and ``nprobe`` to
    as many cells as a sample of ``PROBE_SAMPLE`` queries needs for ``recall``
    (one exact search of the sample; a query set no larger than that is
    measured whole).  ``nprobe = nlist`` is exact.
    """
    if nlist is None:
        nlist = max(1, round(corpus.count() ** 0.5))
    centers = train_cells(corpus, nlist, vec_col)
    cand = []
    for block in _blocks(queries, qid_col, qvec_col, query_block):
        # blocks are cut by hash, so the first one is a fair sample of all queries
        nprobe = nprobe or _probes_for(spark, corpus, block, k, metric, id_col, vec_col, qid_col,
                                       centers, recall)
        cand.append(_search(spark, corpus, block, k, metric, id_col, vec_col, qid_col, centers,
                            min(len(centers), nprobe)))
    return _cut_to_k(cand, spark, k, qid_col, id_col,
                     (queries.schema[qid_col].dataType, corpus.schema[id_col].dataType))


def recall_at_k(approx: DataFrame, exact: DataFrame, qid_col: str = "query_id",
                id_col: str = "vec_id") -> DataFrame:
    """Share of the exact neighbours found, per query."""
    hits = approx.select(qid_col, id_col).join(exact.select(qid_col, id_col),
                                               [qid_col, id_col], "left_semi")
    h = hits.groupBy(qid_col).agg(F.count(F.lit(1)).alias("hits"))
    t = exact.groupBy(qid_col).agg(F.count(F.lit(1)).alias("k"))
    return t.join(h, qid_col, "left").select(
        qid_col, (F.coalesce("hits", F.lit(0)) / F.col("k")).alias("recall"))


def dimension_migration_plan(df: DataFrame, vector_col: str, new_column: str,
                             new_dimension: int, by: list[str] | None = None) -> DataFrame:
    """a new column of the new width + one pending migration row per
    target with the rows that need re-embedding (old column kept)."""
    g = df.groupBy(*(by or [])).agg(
        F.max(vsize(vector_col)).alias("old_dimension"),
        F.count_if(F.col(vector_col).isNotNull()
                   & (F.size(vector_col) != new_dimension)).alias("rows_to_migrate"),
        F.count(F.lit(1)).alias("total_rows"))
    return g.select(*(by or []), F.lit(vector_col).alias("old_column"), "old_dimension",
                    F.lit(new_column).alias("new_column"),
                    F.lit(new_dimension).alias("new_dimension"), "rows_to_migrate", "total_rows",
                    F.lit(0).alias("rows_migrated"), F.lit("pending").alias("status"))
