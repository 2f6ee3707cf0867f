"""Stored sketches, exact percentiles in two passes, and totals kept from changes."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsync.operators import health as H
from vecsync.operators import incremental as IN
from vecsync.operators import monitor as M
from vecsync.streaming.jobs import scratch

KEY = ["t"]


def log(spark, n=6000, days=5, seed=1):
    rnd = random.Random(seed)
    rows = [(f"t{rnd.randrange(2)}", f"r{rnd.randrange(n // 3)}", rnd.choice(["a", "b"]),
             rnd.choice(["success"] * 5 + ["failed", "retry"]),
             None if rnd.random() < 0.05 else rnd.expovariate(0.01), 86_400 * (i % days) + i)
            for i in range(n)]
    df = spark.createDataFrame(rows, "t string, row_id string, embedding_model string, "
                                     "status string, processing_time double, s long")
    return df.withColumn("created_at", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")


def exact(df, first, last):
    ok = F.col("status") == "success"
    ms = F.when(ok, F.col("processing_time"))
    return {r.t: r for r in df.filter(F.to_date("created_at").between(
        F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy("t").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("good"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.avg(ms).alias("avg"),
        F.max("created_at").alias("last"), F.count_distinct("row_id").alias("rows"),
        F.count_distinct("embedding_model").alias("models"),
        F.sort_array(F.collect_list(ms)).alias("all")).collect()}


def test_any_look_back_from_the_store(spark):
    df, path = log(spark), scratch(spark, "sketches")
    H.store_sketches(df, path, KEY)
    for first, last in (("1970-01-01", "1970-01-05"), ("1970-01-02", "1970-01-03"),
                        ("1970-01-04", "1970-01-04"), ("1980-01-01", "1980-01-02")):
        got = H.health_between(spark, path, first, last, 0.95, KEY)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "day" in plan
        want, e = exact(df, first, last), M.kll_rank_error()
        rows = got.collect()
        assert {r.t for r in rows} == set(want)
        for r in rows:
            w = want[r.t]
            assert (r.total, r.successful, r.failed) == (w["total"], w.good, w.failed)
            assert r.avg_ms == pytest.approx(w.avg) and r.last_vectorization == w.last
            assert r.distinct_models == w.models
            assert abs(r.distinct_rows - w["rows"]) <= 0.07 * w["rows"] + 1
            place = np.searchsorted(w.all, r.p_ms) / len(w.all)
            assert abs(place - 0.95) <= e + 1 / len(w.all)
            assert r.p_low_ms <= np.quantile(w.all, 0.95, method="higher")
            assert r.p_high_ms >= np.quantile(w.all, 0.95, method="lower")


def test_a_day_written_again_replaces_its_rows(spark):
    df, path = log(spark), scratch(spark, "sketches")
    H.store_sketches(df, path, KEY)
    some = df.filter(F.to_date("created_at") == F.lit("1970-01-02").cast("date"))
    before = {r.t: r["total"] for r in H.health_between(spark, path, "1970-01-01", "1970-01-05",
                                                        0.95, KEY).collect()}
    H.store_sketches(some, path, KEY)
    H.store_sketches(df.filter(F.to_date("created_at") > F.lit("1970-01-03").cast("date")), path,
                     KEY)
    after = {r.t: r["total"] for r in H.health_between(spark, path, "1970-01-01", "1970-01-05",
                                                       0.95, KEY).collect()}
    assert before == after
    none = H.health_between(spark, path, "1990-01-01", "1990-01-05", 0.95, KEY)
    assert none.count() == 0


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [3.0] * 500, list(range(1000)), [0.0] * 990 + list(range(1, 11)),
    "random", "many"])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_exact_percentile_equals_the_built_in(spark, monkeypatch, values, q):
    rng = np.random.default_rng(4)
    if values == "random":
        values = rng.exponential(size=3000).tolist()
    if values == "many":                                # too many values between the bounds
        monkeypatch.setattr(M, "NARROW", 20)
        values = rng.normal(size=4000).tolist()
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    want = df.agg(F.expr(f"percentile(x, {q})")).first()[0]
    assert M.exact_percentile(df.repartition(4), "x", q) == pytest.approx(want, abs=1e-9)


def test_exact_percentile_reads_the_values_twice(spark):
    """One pass for the sketch, one for the values between its bounds."""
    df = spark.createDataFrame([(float(i % 977),) for i in range(20_000)], "x double")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    assert M.exact_percentile(df.mapInPandas(count, "x double"), "x", 0.95) == pytest.approx(
        df.agg(F.expr("percentile(x, 0.95)")).first()[0])
    assert seen.value == 2 * 20_000
    assert M.exact_percentile(df.limit(0), "x", 0.95) is None


def users(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, v array<float>")


def counted(df):
    return sorted(map(tuple, M.null_vector_counts(df, "v", ["g"]).collect()), key=str)



def test_totals_follow_inserts_updates_deletes_and_replays(spark):
    missing = F.col("v").isNull()
    steps = [[(i, f"g{i % 3}", None if i % 2 else [1.0]) for i in range(60)]]
    steps.append([(i, g, [2.0] if i % 4 == 1 else v) for i, g, v in steps[0] if i % 7])  # delete
    steps.append([(i, "g9" if i % 10 == 3 else g, v) for i, g, v in steps[1]])          # moved
    steps.append(steps[2] + [(100 + i, None, None) for i in range(5)])                  # no group
    steps.append([r for r in steps[3] if r[1] != "g0"])                                 # a group ends
    tables = [users(spark, s) for s in steps]
    store = IN.Totals(spark, scratch(spark, "totals"), tables[0].schema["g"].dataType)
    store.start(M.null_vector_counts(tables[0], "v", ["g"]).withColumnRenamed("g", "group"))
    for n, (old, new) in enumerate(zip(tables, tables[1:])):
        changes = IN.row_changes(old, new, "id", "g", missing)
        for _ in range(2):                              # every batch is replayed
            store.apply(n, changes)
        got = sorted(((r["group"], r.null_vectors, r.total_rows)
                      for r in store.current().collect()), key=str)
        assert got == counted(new)
        if n == 1:
            store = store.fold(scratch(spark, "totals"))
            store.apply(0, IN.row_changes(*tables[:2], "id", "g", missing))   # late replay
    final = {r["group"]: r.completion_percentage for r in store.current().collect()}
    assert float(final[None]) == 0.0
    assert IN.row_changes(tables[0], tables[0], "id", "g", missing).count() == 0


def test_changes_join_ids_groups_and_flags_only(spark):
    old = users(spark, [(1, "a", None)]).withColumn("text", F.lit("long text"))
    plan = IN.row_changes(old, old, "id", "g", F.col("v").isNull())._jdf.queryExecution()
    assert "long text" not in plan.optimizedPlan().toString()
