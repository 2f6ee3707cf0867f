"""Stored inverted-file index: equal to the exact search, and reads the probed cells only."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from support import SF01
from vecsync.operators import ivf, knn
from vecsync.streaming.jobs import scratch

D = 12


def clustered(n=4000, centres=40, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, D)) * 8
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, D))


def corpus_of(spark, vectors, kind="long"):
    rows = [(i if kind == "long" else f"id-{i:06d}", v if v is None else list(map(float, v)))
            for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>").repartition(6)


def queries_of(spark, vectors, kind="long"):
    rows = [(i if kind == "long" else f"q{i}", list(map(float, v))) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"query_id {kind}, query_vector array<double>")


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], None if r["score"] != r["score"]
                   else round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_exact_search_in_the_index_equals_the_exact_search(spark, metric, kind):
    vectors = clustered()
    qs = np.vstack([vectors[::200] + 0.1, clustered(20, 20, 9)])   # inside and far away
    corpus, queries = corpus_of(spark, vectors, kind), queries_of(spark, qs, kind)
    index = ivf.Index(spark, ivf.build(corpus, scratch(spark, "ivf"), metric))
    got = ivf.search(index, queries, 10, exact=True)
    want = knn.knn_exact(spark, corpus, queries, 10, metric)
    assert got.schema == want.schema
    assert ranked(got) == ranked(want)


def test_probed_cells_are_the_only_ones_read(spark, monkeypatch):
    vectors = clustered()
    queries = queries_of(spark, vectors[:6])
    index = ivf.Index(spark, ivf.build(corpus_of(spark, vectors), scratch(spark, "ivf")))
    asked, read = [], ivf.Index.read
    monkeypatch.setattr(ivf.Index, "read", lambda self, c: asked.append(c) or read(self, c))
    for more in ({"nprobe": 2}, {"exact": True}):
        asked.clear()
        found = ivf.search(index, queries, 10, **more)
        assert asked and all(0 < len(c) < len(index.cell) / 2 for c in asked)
        assert "PartitionFilters: [cell" in found._jdf.queryExecution().executedPlan().toString()
        own = read(index, asked[-1])
        assert {r.cell for r in own.select("cell").distinct().collect()} == set(asked[-1].tolist())
        assert own.count() < len(vectors) / 2


def test_bounds_hold_for_every_row(spark):
    vectors = clustered(1500, 12)
    index = ivf.Index(spark, ivf.build(corpus_of(spark, vectors), scratch(spark, "ivf")))
    queries = clustered(30, 9, 5)
    low = index.bounds(index.distances(queries))
    at = {c: j for j, c in enumerate(index.cell.tolist())}
    rows = index.vectors.collect()
    assert len(rows) == len(vectors) and sum(index.n) == len(vectors)
    for r in rows:
        d = np.sqrt(((queries - np.array(r["vector"])) ** 2).sum(axis=1))
        assert (low[:, at[r["cell"]]] <= d + 1e-6).all()
        c = index.centers[at[r["cell"]]]
        assert r["far"] == pytest.approx(np.sqrt(((np.array(r["vector"]) - c) ** 2).sum()))


@pytest.mark.parametrize("given", [True, False])
def test_recall_of_few_probes(spark, given):
    """At least 0.9 on clustered vectors and on the given ones, for off-centre queries too."""
    from vecsync.plans.registry import QUERIES
    if given:
        rec = [r[0] for r in QUERIES["knn_ivf_index"](spark, SF01).groupBy("query_id")
               .agg(F.first("recall")).select("first(recall)").collect()]
        assert len(rec) == spark.read.parquet(f"{SF01}/benchmark.parquet").count()
    else:
        vectors = clustered(6000, 60)
        queries = queries_of(spark, np.vstack([vectors[:300] + 0.05, clustered(100, 100, 3)]))
        corpus = corpus_of(spark, vectors)
        index = ivf.Index(spark, ivf.build(corpus, scratch(spark, "ivf")))
        rec = [r["recall"] for r in knn.recall_at_k(
            ivf.search(index, queries, 10), knn.knn_exact(spark, corpus, queries, 10)).collect()]
        assert len(rec) == 400
    assert np.mean(rec) >= 0.9


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_rows_without_a_distance(spark, metric):
    """NaN, zero and missing vectors, other widths, missing ids: as in the exact search."""
    vectors = list(clustered(60, 3))
    vectors[3], vectors[9] = np.full(D, np.nan), None
    vectors[5] = np.zeros(D)
    corpus = corpus_of(spark, vectors).unionByName(
        spark.createDataFrame([(None, [0.0] * D)], "vec_id long, embedding array<double>"))
    queries = queries_of(spark, [vectors[0], np.zeros(D)])
    index = ivf.Index(spark, ivf.build(corpus, scratch(spark, "ivf"), metric, cells=4))
    for k in (5, 59, 100):
        got = ivf.search(index, queries, k, exact=True)
        assert ranked(got) == ranked(knn.knn_exact(spark, corpus, queries, k, metric))
    wide = corpus.unionByName(spark.createDataFrame([(7777, [1.0])],
                                                    "vec_id long, embedding array<double>"))
    index = ivf.Index(spark, ivf.build(wide, scratch(spark, "ivf"), metric, cells=4))
    assert index.odd >= 2 and index.width == D


def test_empty_corpus_equal_rows_and_wrong_metric(spark):
    none = corpus_of(spark, [])
    index = ivf.Index(spark, ivf.build(none, scratch(spark, "ivf")))
    assert ivf.search(index, queries_of(spark, [[1.0]]), 3, exact=True).count() == 0
    assert ivf.search(index, queries_of(spark, [[1.0]]), 3).count() == 0
    same = corpus_of(spark, [np.ones(D)] * 200)
    index = ivf.Index(spark, ivf.build(same, scratch(spark, "ivf"), cells=5))
    got = ivf.search(index, queries_of(spark, [np.ones(D)]), 7, exact=True)
    assert [r.vec_id for r in got.orderBy("rank").collect()] == list(range(7))
    with pytest.raises(ValueError):
        ivf.build(none, scratch(spark, "ivf"), "ip")
