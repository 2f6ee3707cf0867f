"""T4 by quantised filter and refine: exact k-NN that reads most rows as one byte a component.

``write_codes`` stores, for every vector once, a code of one signed byte a component, its scale,
and ``err``, the distance between the vector and what the code stands for.  So for a query q and
a code's vector c

    l2       d(q, c) - err          <= d(q, x) <= d(q, c) + err
    ip       -(q c) - |q| err       <= -(q x)  <= -(q c) + |q| err
    cosine   as ip, between unit vectors, plus 1

A first scan of the codes keeps, per task and query, the k smallest upper bounds; the k-th over
all tasks is a limit that the k-th neighbour cannot exceed.  A second scan gives the rows whose
lower bound is at or below it.  Only these are looked up among the full vectors and scored, as
the exact search scores them, so the result is the same; ``refined`` says how many there were.

Rows without a bound (another width, NaN, for cosine a zero vector) are always looked up.

Bounds: a block of queries and its limits are what tasks receive; k rows for each query and
task reach the shuffle of the first scan.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .knn import (QUERY_BLOCK, SCORE_CELLS, _blocks, _cut_to_k, _metric_scores, _Running,
                  id_kind)

SLACK = 1e-6


def _codes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, err) of vectors; err is NaN where there is no bound."""
    with np.errstate(invalid="ignore", divide="ignore"):
        scale = np.abs(rows).max(axis=1, initial=0.0) / 127.0
        scale = np.where(np.isfinite(scale) & (scale > 0), scale, 1.0)
        code = np.clip(np.nan_to_num(np.round(rows / scale[:, None])), -127, 127).astype(np.int8)
        err = np.sqrt(((rows - code * scale[:, None]) ** 2).sum(axis=1)) * (1 + SLACK)
    return code, scale, err


def write_codes(corpus: DataFrame, path: str, metric: str = "l2", id_col: str = "vec_id",
                vec_col: str = "embedding") -> str:
    """Codes of ``corpus`` to the new folder ``path``: id, code, scale, err.  Rows without an id
    or a vector are nobody's neighbours and left out."""
    if metric not in ("l2", "ip", "cosine"):
        raise ValueError(metric)
    _, kind, own = id_kind(corpus, id_col)

    def run(batches):
        for pdf in batches:
            out = [(None, np.nan, np.nan)] * len(pdf)
            vectors = pdf["vector"].to_numpy()
            width = np.array([len(v) for v in vectors])
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                rows = np.stack([np.asarray(vectors[i], dtype=np.float64) for i in at])
                if metric == "cosine":
                    with np.errstate(invalid="ignore", divide="ignore"):
                        rows = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
                for i, c, s, e in zip(at, *_codes(rows)):
                    out[i] = (c.tobytes(), s, e)
            yield pd.DataFrame({"id": pdf["id"], "code": [x[0] for x in out],
                                "scale": [x[1] for x in out], "err": [x[2] for x in out]})

    src = corpus.select(F.col(id_col).cast(kind).alias("id"), F.col(vec_col).alias("vector"))
    coded = src.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).mapInPandas(
        run, f"id {kind}, code binary, scale double, err double")
    coded.withColumn("id", F.col("id").cast(own)).write.parquet(path)
    return path


def _ranges(pdf: pd.DataFrame, mat: np.ndarray, metric: str):
    """(lower, upper) score bounds, rows × queries, of a batch of codes; rows without a bound
    get -inf and inf."""
    low = np.full((len(pdf), len(mat)), -np.inf)
    high = np.full((len(pdf), len(mat)), np.inf)
    err = pdf["err"].to_numpy(np.float64)
    ok = np.array([c is not None and len(c) == mat.shape[1] for c in pdf["code"]]) & ~np.isnan(err)
    if ok.any():
        code = np.stack([np.frombuffer(c, np.int8) for c in pdf["code"][ok]]).astype(np.float64)
        rows = code * pdf["scale"].to_numpy()[ok][:, None]
        norm = np.sqrt((mat * mat).sum(axis=1))
        if metric == "cosine":
            with np.errstate(invalid="ignore", divide="ignore"):
                at = 1.0 - rows @ (mat / norm[:, None]).T
            off = np.repeat(err[ok][:, None], len(mat), axis=1)
        else:
            at = _metric_scores(rows, mat, metric, norm)
            off = err[ok][:, None] * (norm[None, :] if metric == "ip" else 1.0)
        off = off + SLACK * (1 + np.abs(at))
        low[ok], high[ok] = at - off, at + off
        gone = np.isnan(at)
        low[ok] = np.where(gone, -np.inf, low[ok])
        high[ok] = np.where(gone, np.inf, high[ok])
    return low, high


def knn_filtered(codes_path: str, corpus: DataFrame, queries: DataFrame, k: int, scratch: str,
                 metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding",
                 qid_col: str = "query_id", qvec_col: str = "query_vector",
                 query_block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(result, refined): the ``k`` nearest rows per query as ``knn.knn_exact`` gives them, and
    per query how many rows were looked up.  ``scratch``: a new shared folder."""
    spark = corpus.sparkSession
    numpy_kind, kind, own = id_kind(corpus, id_col)
    codes = spark.read.parquet(codes_path)
    narrow = codes.select(F.col("id").cast(kind).alias("id"), "code", "scale", "err")
    vectors = corpus.select(F.col(id_col).cast(kind).alias("id"), F.col(vec_col).alias("vector"))
    cand, passed = [], []
    for number, (ids_q, mat) in enumerate(_blocks(queries, qid_col, qvec_col, query_block)):
        sent = spark.sparkContext.broadcast(mat)
        step = max(1, SCORE_CELLS // len(mat))

        def upper(batches):
            mat, least = sent.value, None
            for pdf in batches:
                for lo in range(0, len(pdf), step):
                    _, high = _ranges(pdf.iloc[lo:lo + step], mat, metric)
                    least = high if least is None else np.concatenate([least, high])
                    least = np.partition(least, min(k, len(least)) - 1, axis=0)[:k]
            if least is not None:
                yield pd.DataFrame({"query": np.tile(np.arange(len(mat)), len(least)),
                                    "high": least.ravel()})

        marks = narrow.mapInPandas(upper, "query int, high double").filter(
            F.col("high") < float("inf"))
        w = Window.partitionBy("query").orderBy("high")
        kth = (marks.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= k)
               .groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("high").alias("high")))
        limit = np.full(len(mat), np.inf)
        for q, n, high in kth.collect():                       # one row per query
            if n == k:
                limit[q] = high
        bound = spark.sparkContext.broadcast(limit)

        def within(batches):
            mat, limit = sent.value, bound.value
            for pdf in batches:
                for lo in range(0, len(pdf), step):
                    part = pdf.iloc[lo:lo + step]
                    low, _ = _ranges(part, mat, metric)
                    r, q = np.nonzero(~(low > limit[None, :]))
                    yield pd.DataFrame({"id": part["id"].to_numpy()[r], "query": q})

        place = f"{scratch}/survivors-{number}"
        narrow.mapInPandas(within, f"id {kind}, query int").write.parquet(place)
        kept = spark.read.schema(f"id {kind}, query int").parquet(place)
        names = spark.createDataFrame([(i, x.item() if hasattr(x, "item") else x)
                                       for i, x in enumerate(ids_q)],
                                      f"query int, {qid_col} "
                                      + ("string" if ids_q.dtype == object else "long"))
        passed.append(kept.groupBy("query").agg(F.count(F.lit(1)).alias("looked_up"))
                      .join(F.broadcast(names), "query").drop("query"))
        asked = kept.groupBy("id").agg(F.collect_list("query").alias("asked"))
        query_kind = "string" if ids_q.dtype == object else "long"
        named = spark.sparkContext.broadcast(ids_q)

        def refine(batches):
            mat, ids_q = sent.value, named.value
            norm = np.sqrt((mat * mat).sum(axis=1))
            best = _Running(k, numpy_kind)
            for pdf in batches:
                for lo in range(0, len(pdf), step):
                    part = pdf.iloc[lo:lo + step]
                    rows = np.stack([np.asarray(v, dtype=np.float64) for v in part["vector"]])
                    score = _metric_scores(rows, mat, metric, norm)
                    wants = np.zeros(score.shape, bool)
                    for i, qs in enumerate(part["asked"]):
                        wants[i, np.asarray(qs, dtype=np.int64)] = True
                    ids = part["id"].to_numpy().astype(numpy_kind)
                    for q in np.flatnonzero(wants.any(axis=0)):
                        own = wants[:, q]
                        best.add(ids[own], np.array([q]), score[own][:, [q]])
            if len(best.q):
                yield pd.DataFrame({qid_col: ids_q[best.q], id_col: best.id, "score": best.s})

        cand.append(vectors.join(asked, "id").mapInPandas(
            refine, f"{qid_col} {query_kind}, {id_col} {kind}, score double"))
    result = _cut_to_k(cand, spark, k, qid_col, id_col, (queries.schema[qid_col].dataType, own))
    refined = spark.createDataFrame([], f"looked_up long, {qid_col} string")
    for p in passed:
        refined = refined.unionByName(p.withColumn(qid_col, F.col(qid_col).cast("string")))
    return result, refined.select(F.col(qid_col).cast(queries.schema[qid_col].dataType)
                                  .alias(qid_col), "looked_up")
