"""Quantised filter and refine: the exact search's result from few full vectors."""
import numpy as np
import pytest

from test_ivf import D, clustered, corpus_of, queries_of, ranked
from vecsync.operators import knn
from vecsync.operators import quantised as Q
from vecsync.streaming.jobs import scratch


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_bounds_hold(metric):
    rng = np.random.default_rng(1)
    rows, qs = rng.normal(size=(200, D)) * rng.exponential(size=(200, 1)), rng.normal(size=(9, D))
    import pandas as pd
    own = rows / np.linalg.norm(rows, axis=1)[:, None] if metric == "cosine" else rows
    code, scale, err = Q._codes(own)
    pdf = pd.DataFrame({"code": [c.tobytes() for c in code], "scale": scale, "err": err})
    low, high = Q._ranges(pdf, qs, metric)
    true = knn._metric_scores(rows, qs, metric, np.linalg.norm(qs, axis=1))
    assert (low <= true).all() and (true <= high).all() and np.isfinite(low).all()


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("kind,block", [("long", 4096), ("string", 9)])
def test_equal_to_the_exact_search(spark, metric, kind, block):
    vectors = clustered()
    corpus = corpus_of(spark, vectors, kind)
    queries = queries_of(spark, np.vstack([vectors[::400], clustered(8, 8, 4)]), kind)
    codes = Q.write_codes(corpus, scratch(spark, "codes"), metric)
    got, refined = Q.knn_filtered(codes, corpus, queries, 10, scratch(spark, "f"), metric,
                                  query_block=block)
    want = knn.knn_exact(spark, corpus, queries, 10, metric)
    assert got.schema == want.schema and ranked(got) == ranked(want)
    looked = [r.looked_up for r in refined.collect()]
    assert len(looked) == queries.count() and min(looked) >= 10
    if metric == "l2":                                  # a few of 4,000 rows in full
        assert np.mean(looked) < 400


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_rows_without_a_bound(spark, metric):
    vectors = list(clustered(60, 3))
    vectors[3], vectors[9], vectors[5] = np.full(D, np.nan), None, np.zeros(D)
    corpus, queries = corpus_of(spark, vectors), queries_of(spark, [vectors[0], np.zeros(D)])
    codes = Q.write_codes(corpus, scratch(spark, "codes"), metric)
    for k in (4, 59, 80):
        got, _ = Q.knn_filtered(codes, corpus, queries, k, scratch(spark, "f"), metric)
        assert ranked(got) == ranked(knn.knn_exact(spark, corpus, queries, k, metric))
    same = corpus_of(spark, [np.ones(D)] * 90)
    codes = Q.write_codes(same, scratch(spark, "codes"))
    got, _ = Q.knn_filtered(codes, same, queries_of(spark, [np.ones(D)]), 5, scratch(spark, "f"))
    assert [r.vec_id for r in got.orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    none = corpus_of(spark, [])
    codes = Q.write_codes(none, scratch(spark, "codes"))
    assert Q.knn_filtered(codes, none, queries, 3, scratch(spark, "f"))[0].count() == 0
