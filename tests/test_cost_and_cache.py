"""Embedding cache, packed requests, waves with feedback."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsync.operators import embed as EM
from vecsync.operators import packing as PK
from vecsync.operators import vector_cache as VC
from vecsync.operators import waves as WV
from vecsync.streaming.jobs import scratch


def texts(spark, rows):
    return spark.createDataFrame(rows, "id long, t string").repartition(5)


def run(spark, df, cache, **more):
    got = VC.embed_cached(df, "id", "t", cache, scratch(spark, "cached"), "m", 8, **more)
    return {r.id: r for r in got.collect()}


def sent(spark, cache_run):
    return sum(r.sent for r in cache_run.values())


def test_each_distinct_text_is_sent_once_and_hits_are_never_lost(spark):
    cache = VC.VectorCache.create(spark, scratch(spark, "cache"), parts=8, bits=1 << 14)
    rows = [(i, f"text {i % 300}") for i in range(900)] + [(1000, None), (1001, "")]
    tries = []

    def calls(df):
        """Rows of the provider's step: one for each text that was sent."""
        place = scratch(spark, "cached")
        got = VC.embed_cached(df, "id", "t", cache, place, "m", 8)
        out = {r.id: r for r in got.collect()}
        tries.append(spark.read.parquet(f"{place}/tried").count())
        return out

    first = calls(texts(spark, rows))
    assert tries == [301]
    assert first[1000].outcome == "skipped" and first[1000].vector is None
    assert all(first[i].outcome == "success" for i in range(900))
    again = calls(texts(spark, rows + [(2000 + i, f"new {i}") for i in range(40)]))
    assert tries[1] == 40
    assert all(again[i].outcome == "hit" and again[i].sent == 0 for i in range(900))
    assert all(again[i].vector == first[i].vector for i in range(900))
    mock = EM.MockEmbedder(dimension=8)
    assert again[5].vector == pytest.approx(mock.embed(["text 5"])[0].tolist())
    third = calls(texts(spark, rows + [(2000 + i, f"new {i}") for i in range(40)]))
    assert tries[2] == 0 and {r.outcome for r in third.values()} == {"hit", "skipped"}
    other = VC.embed_cached(texts(spark, rows), "id", "t", cache, scratch(spark, "cached"),
                            "another model", 8).collect()
    assert {r.outcome for r in other} == {"success", "skipped"}


def test_refusals_are_not_cached(spark):
    cache = VC.VectorCache.create(spark, scratch(spark, "cache"), parts=4, bits=1 << 12)
    rows = [(i, "x" * (1 + i % 20)) for i in range(100)]
    bad = dict(provider="faulty", modulus=10, dead=7, busy=9)
    first = run(spark, texts(spark, rows), cache, **bad)
    second = run(spark, texts(spark, rows), cache, **bad)
    for i, t in rows:
        kind = {7: "dead", 9: "retry"}.get(len(t) % 10, "success")
        assert first[i].outcome == kind
        assert second[i].outcome == ("hit" if kind == "success" else kind)


def test_filters_prune_folders_and_keep_their_rate(spark):
    parts, bits, n = 4, 12 * 4096, 16_000
    cache = VC.VectorCache.create(spark, scratch(spark, "cache"), parts=parts, bits=bits)
    own = spark.range(n).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"),
                                F.array(F.col("id").cast("float")).alias("vector"))
    cache.add(own)
    assert cache.maybe(own).count() == n                # none is lost
    strangers = spark.range(n, 5 * n).select(
        F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    rate = cache.maybe(strangers).count() / (4 * n)
    stated = VC.false_positive_rate(n / parts, bits)
    assert 0.004 < stated < 0.009 and rate <= 2 * stated
    one = own.limit(1).select("digest")
    found = cache.lookup(one, scratch(spark, "passed"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan
    assert found.count() == 1
    none = cache.lookup(strangers.limit(3), scratch(spark, "passed"))
    assert none.count() == 0


@pytest.mark.parametrize("kind", ["even", "small", "large", "half", "both", "odd"])
def test_packing_keeps_limits_and_nears_the_bound(kind):
    rnd = random.Random(kind)
    draw = {"even": lambda: rnd.randint(1, 1000), "small": lambda: rnd.randint(1, 20),
            "large": lambda: rnd.randint(300, 1000), "half": lambda: rnd.randint(480, 520),
            "both": lambda: rnd.choice([1, 2, 3, 5, 60, 200, 400]),
            "odd": lambda: rnd.choice([1, 334, 1000, 999, 2500])}[kind]
    for n in (0, 1, 2, 40, 3000):
        sizes = [draw() for _ in range(n)]
        got = PK.best_fit(sizes, 16, 1000)
        many, full = np.bincount(got, minlength=1), np.bincount(got, sizes, minlength=1)
        assert n == 0 or (many.max() <= 16 and many.min() >= 1)
        alone = [g for g, s in zip(got, sizes) if s > 1000]
        assert all(many[g] == 1 for g in alone)
        assert all(f <= 1000 or g in alone for g, f in enumerate(full))
        assert len(set(got)) <= 1.25 * PK.lower_bound(sizes, 16, 1000) + 1


def test_requests_of_a_table(spark):
    rnd = random.Random(3)
    rows = [(i, f"b{i % 3}" if i % 7 else None, "w" * rnd.randint(0, 900) if i % 50 else None)
            for i in range(3000)] + [(5000, "b1", "z" * 9000)]
    df = spark.createDataFrame(rows, "id long, b string, t string")
    packed = PK.pack_requests(df.repartition(7), "id", "t", 16, 1000, ["b"])
    got = {r.id: r for r in packed.collect()}
    assert len(got) == len(rows)
    again = {r.id: r.request for r in PK.pack_requests(df.repartition(3).orderBy(F.rand()), "id",
                                                       "t", 16, 1000, ["b"]).collect()}
    assert all(again[i] == r.request for i, r in got.items())      # whatever the partitions
    by = {}
    for i, b, t in rows:
        r = got[i]
        assert (r.request is None) == (t is None)
        if t is not None:
            assert r.tokens == max(1, -(-len(t) // 4)) and r.oversize == (r.tokens > 1000)
            by.setdefault(r.request, []).append((b, r.tokens))
    assert all(len(x) <= 16 and len({b for b, _ in x}) == 1
               and (sum(s for _, s in x) <= 1000 or len(x) == 1) for x in by.values())
    totals = {r.b: r for r in PK.request_totals(packed, 16, 1000, ["b"]).collect()}
    for b, r in totals.items():
        sizes = [s for x in by.values() for o, s in x if o == b]
        assert r.lower_bound == PK.lower_bound(sizes, 16, 1000)
        assert r.requests <= 1.25 * r.lower_bound + 1
    none = PK.pack_requests(df.limit(0), "id", "t", 16, 1000)
    assert none.count() == 0


def test_a_request_is_one_call(spark):
    class Recording(EM.MockEmbedder):
        """Says in every vector how many texts its request had."""

        def embed(self, texts):
            return [[float(len(texts)), float(sum(map(len, texts)))] for _ in texts]

    EM.register_provider("recording", Recording)
    rows = [(i, "w" * (i % 37), f"r{i % 11}") for i in range(700)] + [(900, None, None)]
    df = spark.createDataFrame(rows, "id long, t string, request string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.id: r for r in PK.embed_requests(df, "t", "recording", dimension=2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for _, t, r in rows[:-1]:
        n, c = want.get(r, (0, 0))
        want[r] = (n + 1, c + len(t))
    assert all(tuple(got[i].vector) == tuple(map(float, want[r])) and got[i].sent == 1
               for i, _, r in rows[:-1])
    assert got[900].outcome == "skipped" and got[900].vector is None


def test_concurrency_follows_refusals():
    assert WV.next_concurrency(4, 0, 64) == 5 and WV.next_concurrency(64, 0, 64) == 64
    assert WV.next_concurrency(9, 1, 64) == 4 and WV.next_concurrency(1, 5, 64) == 1


def test_waves_end_with_bounded_refusals(spark):
    df = texts(spark, [(i, f"text {i}") for i in range(1200)] + [(5000, None)])
    got, waves = WV.embed_in_waves(df, "id", "t", scratch(spark, "waves"), "throttled", start=12,
                                   rows_per_task=50, limit=3, dimension=8)
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == 1201 and got.count() == 1201
    assert all(rows[i].outcome == "success" and len(rows[i].vector) == 8 for i in range(1200))
    assert rows[5000].outcome == "skipped"
    log = waves.orderBy("wave").collect()
    for a, b in zip(log, log[1:]):
        assert b.concurrency == WV.next_concurrency(a.concurrency, a.refused, 64)
    late = [w for w in log if w.wave > 3]               # it has come down by then
    assert max(w.concurrency for w in late) <= 4 and min(w.concurrency for w in log) >= 1
    # a saw tooth around the limit: at most half of what is sent is refused
    assert sum(w.refused for w in late) <= 0.5 * sum(w.rows for w in late)
    none, log = WV.embed_in_waves(df.limit(0), "id", "t", scratch(spark, "waves"))
    assert none.count() == 0 and log.count() == 0


def test_rows_that_stay_refused_come_back_as_they_are(spark):
    df = texts(spark, [(i, "x" * (i % 10)) for i in range(100)])
    got, _ = WV.embed_in_waves(df, "id", "t", scratch(spark, "waves"), "faulty", passes=3,
                               rows_per_task=30, modulus=10, dead=7, busy=9, dimension=4)
    kinds = {r.id: r.outcome for r in got.collect()}
    assert len(kinds) == 100
    assert all(kinds[i] == {7: "dead", 9: "retry"}.get(i % 10, "success") for i in kinds)
