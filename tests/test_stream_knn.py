"""Batch ≡ streaming, k-NN exactness and IVF recall, skew-safe batch numbering."""
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from support import SF001, SF01
from vecsync.operators import detect, knn as KN
from vecsync.operators.embed import batch_plan
from vecsync.plans import derive
from vecsync.sources.tables import read_table
from vecsync.streaming import jobs as ST


def feed(spark):
    return derive.change_feed(read_table(spark, SF001, "events"))


def test_stream_debounce_multi_batch_equals_batch(spark):
    f = feed(spark)
    path = ST.land_feed_in_order(f, ST.scratch(spark, "t-land"), chunks=4)
    p = ST.parsed(ST.read_feed(spark, path, 1)).select("event_id", "table", "row_id", "ts")
    s = ST.stream_debounce(p, ["table", "row_id"], "ts", 3600.0,
                           "event_id long, table string, row_id string, ts timestamp_ntz")
    got = ST.run_to_table(spark, s, "t-dedup")
    batch = detect.debounce(ST.parsed(f).select("event_id", "table", "row_id", "ts"),
                            ["table", "row_id"], "ts", 3600.0)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in batch.collect())


def test_stream_vectorize_is_replay_safe(spark):
    def run(replay):
        f = feed(spark)
        path = ST.land_feed(f, ST.scratch(spark, "t-land2"), files=4)
        if replay:
            f.write.mode("append").parquet(path)   # every event again, after the rest
        out, ck = ST.scratch(spark, "t-vec"), ST.scratch(spark, "t-vec-ck")
        ST.stream_vectorize(spark, ST.read_feed(spark, path, 2), derive.routing_config(spark),
                            out, ck, 8, "m").awaitTermination()
        cur = ST.current_vectors(spark, out)
        return sorted((r.table, r.row_id, r.event_id) for r in cur.collect())
    assert run(False) == run(True)


def test_debounce_hot_key_matches_plain_window(spark):
    # one key holds most rows: the bucketed form must equal a plain lag window
    rows = [(i, "hot" if i % 5 else f"k{i}", i * 700) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, s long") \
        .withColumn("ts", F.timestamp_seconds("s"))
    got = detect.debounce(df, ["k"], "ts", 1000.0, bucket_seconds=3600)
    w = Window.partitionBy("k").orderBy("ts")
    gap = F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(w))
    want = df.withColumn("g", gap).filter(F.col("g").isNull() | (F.col("g") >= 1000))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_debounce_keeps_events_without_a_time(spark):
    rows = [(1, "a", None), (2, "a", 100), (3, "a", 200), (4, "a", 9000), (5, "b", None),
            (6, "b", None)]
    df = spark.createDataFrame(rows, "id long, k string, s long") \
        .withColumn("ts", F.timestamp_seconds("s"))
    got = detect.debounce(df, ["k"], "ts", 1000.0)
    assert sorted(r.id for r in got.collect()) == [1, 2, 4, 5, 6]


def test_batch_plan_null_groups_and_mixed_keys(spark):
    rows = [(None if i % 5 == 0 else f"g{i % 3}", i % 7, f"k{i:04d}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, a int, b string, v long")
    got = {(r.g, r.b): r.row_number for r in batch_plan(df, ["g"], ["a", "b"], 10).collect()}
    w = Window.partitionBy("g").orderBy("a", "b")
    want = {(r.g, r.b): r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want
    assert batch_plan(df.limit(0), ["g"], ["a", "b"], 10).count() == 0


def test_batch_plan_skewed_group(spark):
    rows = [(0 if i % 10 else i % 3 + 1, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g int, id long").repartition(7)
    got = batch_plan(df, ["g"], ["id"], 64)
    w = Window.partitionBy("g").orderBy("id")
    want = df.withColumn("row_number", F.row_number().over(w)) \
             .withColumn("batch_no", F.floor((F.col("row_number") - 1) / 64))
    key = lambda r: (r.g, r.id, r.row_number, r.batch_no)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_knn_exact_matches_numpy(spark):
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(400, 8)).astype(np.float32)
    qs = rng.normal(size=(5, 8)).astype(np.float32)
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)],
                                "vec_id long, embedding array<float>").repartition(3)
    qdf = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(qs)],
                                "query_id long, query_vector array<float>")
    for metric in ("l2", "ip", "cosine"):
        got = KN.knn_exact(spark, cdf, qdf, 7, metric)
        c, q = corpus.astype(np.float64), qs.astype(np.float64)
        for qi in range(len(qs)):
            if metric == "l2":
                s = np.sqrt(((c - q[qi]) ** 2).sum(1))
            elif metric == "ip":
                s = -(c @ q[qi])
            else:
                s = 1 - (c @ q[qi]) / (np.linalg.norm(c, axis=1) * np.linalg.norm(q[qi]))
            want = list(np.lexsort((np.arange(len(c)), s))[:7])
            mine = [r.vec_id for r in got.filter(F.col("query_id") == 100 + qi)
                    .orderBy("rank").collect()]
            assert mine == want, metric


def test_ivf_full_probe_has_full_recall(spark):
    rng = np.random.default_rng(5)
    corpus = rng.normal(size=(300, 6)).astype(np.float32)
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)],
                                "vec_id long, embedding array<float>")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus[:6])],
                                "query_id long, query_vector array<float>")
    approx = KN.knn_ivf(spark, cdf, qdf, 5, nlist=4, nprobe=4)
    exact = KN.knn_exact(spark, cdf, qdf, 5)
    rec = [r.recall for r in KN.recall_at_k(approx, exact).collect()]
    assert rec and min(rec) == 1.0


@pytest.mark.parametrize("sf_dir", [SF01, SF01.replace("sf0.01", "sf0.1")])
def test_registered_ivf_query_has_the_required_recall(spark, sf_dir):
    from vecsync.plans.registry import QUERIES
    rec = QUERIES["knn_ivf"](spark, sf_dir).groupBy("query_id").agg(F.first("recall").alias("r"))
    n = read_table(spark, sf_dir, "benchmark").count()
    got = rec.agg(F.count("r"), F.avg("r")).first()
    assert got[0] == n and got[1] >= 0.9


def test_ivf_recall_holds_for_queries_beyond_the_sample(spark):
    rng = np.random.default_rng(11)
    corpus = rng.normal(size=(900, 16)).astype(np.float32)
    qs = rng.normal(1.0, 2.0, size=(KN.PROBE_SAMPLE * 2, 16)).astype(np.float32)   # off centre
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)],
                                "vec_id long, embedding array<float>")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)],
                                "query_id long, query_vector array<float>")
    approx = KN.knn_ivf(spark, cdf, qdf, 10, query_block=128)
    rec = [r.recall for r in KN.recall_at_k(approx, KN.knn_exact(spark, cdf, qdf, 10)).collect()]
    assert len(rec) == len(qs) and np.mean(rec) >= 0.9


def test_attempt_history_hot_key_matches_plain_window(spark):
    from vecsync.operators.tasks import attempt_history
    rows = [(i, "hot" if i % 4 else f"k{i}", i * 500, i % 3 == 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, s long, bad boolean") \
        .withColumn("ts", F.timestamp_seconds("s"))
    got = attempt_history(df, ["k"], "ts", "id", F.col("bad"), bucket_seconds=3600)
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = df.withColumn("attempt_no", F.row_number().over(w)).withColumn(
        "failures_before", F.coalesce(F.sum(F.col("bad").cast("int")).over(
            w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    key = lambda r: (r.id, r.attempt_no, r.failures_before)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_knn_exact_ties_break_by_id(spark):
    base = np.array([[0.0, 1.0], [1.0, 0.0], [1.0, 1.0]], dtype=np.float32)
    corpus = np.repeat(base, 40, axis=0)            # many exact ties
    cdf = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(corpus)],
                                "vec_id long, embedding array<float>").repartition(5)
    qdf = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, query_vector array<float>")
    got = [r.vec_id for r in KN.knn_exact(spark, cdf, qdf, 25).orderBy("rank").collect()]
    s = np.sqrt(((corpus.astype(np.float64) - np.array([0.0, 1.0])) ** 2).sum(1))
    want = list(np.lexsort((np.arange(len(corpus)), s))[:25])
    assert got == want


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
@pytest.mark.parametrize("block", [4096, 2])
def test_knn_with_zero_vectors_and_query_blocks(spark, metric, block):
    """A NaN score ranks last and hides nothing; blocks of queries change nothing."""
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(50, 4))
    corpus[[0, 7]] = 0.0
    queries = np.vstack([corpus[3:8], np.zeros((1, 4))])
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)] + [(99, None)],
                                "vec_id long, embedding array<double>").repartition(30)
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)],
                                "query_id long, query_vector array<double>")
    got = KN.knn_exact(spark, cdf, qdf, 3, metric, query_block=block).collect()
    with np.errstate(invalid="ignore", divide="ignore"):
        for qi, q in enumerate(queries):
            s = {"l2": np.sqrt(((corpus - q) ** 2).sum(1)), "ip": -(corpus @ q),
                 "cosine": 1 - (corpus @ q) / (np.sqrt((corpus ** 2).sum(1) * (q ** 2).sum()))
                 }[metric]
            own = sorted((r for r in got if r.query_id == qi), key=lambda r: r["rank"])
            assert len(own) == 3
            order = np.lexsort((np.arange(50), np.round(s, 9), np.isnan(s)))[:3]
            want = s[order]
            assert np.allclose([r.score for r in own], want, atol=1e-6, equal_nan=True)
            if np.isnan(s).all():
                assert [r.vec_id for r in own] == [0, 1, 2]


@pytest.mark.parametrize("parts,aqe", [(16, "true"), (64, "false")])
def test_batch_plan_of_two_million_rows(spark, parts, aqe):
    """Equal to the plain window, no row missing, with a payload column and hot groups."""
    from pyspark.sql import functions as F
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",
                                           "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        df = spark.range(2_000_000).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.xxhash64("id") % 50).alias("g"),
            F.xxhash64("id", F.lit(1)).alias("o"), F.concat(F.lit("p"), "id").alias("payload"))
        got = batch_plan(df, ["g"], ["o"], 64)
        w = Window.partitionBy("g").orderBy("o")
        want = df.withColumn("rn", F.row_number().over(w))
        both = want.join(got, ["g", "o"], "left")
        r = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(
            (F.col("rn") == F.col("row_number"))
            & (F.col("batch_no") == F.floor((F.col("rn") - 1) / 64))).alias("ok")).first()
        assert got.count() == 2_000_000 and r.n == r.ok == 2_000_000
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_watermark_dedup_keeps_one_row_per_key_in_a_batch(spark):
    f = feed(spark)
    path = ST.land_feed(f, ST.scratch(spark, "t-land3"), files=2)
    p = ST.parsed(ST.read_feed(spark, path)).select("event_id", "table", "row_id", "ts") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    got = ST.run_to_table(spark, ST.stream_dedup(p, ["table", "row_id"], "ts", "1 hour"),
                          "t-wm-dedup")
    keys = ST.parsed(f).select("table", "row_id").distinct().count()
    assert got.count() == keys
    assert got.select("table", "row_id").distinct().count() == keys


def test_late_replay_is_dropped_and_counted(spark):
    f = feed(spark)
    path = ST.land_feed_in_order(f, ST.scratch(spark, "t-land4"), chunks=3)
    # an early slice arrives again after everything else: behind the watermark
    f.filter(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")) \
        .write.mode("append").parquet(path)
    p = ST.parsed(ST.read_feed(spark, path, 1)).select("event_id", "table", "row_id", "ts")
    s = ST.stream_debounce(p, ["table", "row_id"], "ts", 3600.0,
                           "event_id long, table string, row_id string, ts timestamp_ntz",
                           delay="1 hour")
    out = ST.scratch(spark, "t-late-out")
    q = (s.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ST.scratch(spark, "t-late-ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert ST.rows_dropped_by_watermark(q) > 0
    ids = [r.event_id for r in spark.read.parquet(out).collect()]
    assert len(ids) == len(set(ids))          # a replay never duplicates output


HOT_SCHEMA = "event_id long, k string, ts timestamp_ntz"


def hot_feed(spark):
    """One key with four fifths of the events, pauses of 7,000 s, two events without a time."""
    rows = [(i, "hot" if i % 5 else f"k{i % 40}", 1_700_000_000 + i * 7 + i % 3)
            for i in range(24_000) if i // 1000 % 5 != 4]
    return spark.createDataFrame(rows + [(-1, "hot", None), (-2, "k0", None)],
                                 "event_id long, k string, s long").select(
        "event_id", "k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))


def land_in_slices(spark, f, slices):
    path = ST.scratch(spark, "t-hot")
    for n in range(slices):
        f.filter(F.greatest(F.floor(F.col("event_id") * slices / 24_000), F.lit(0)) == n) \
            .coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("window", [10.0, 650.0, 5000.0])
def test_stream_debounce_hot_key_matches_plain_window(spark, window):
    f = hot_feed(spark)
    s = ST.stream_debounce(ST.read_feed(spark, land_in_slices(spark, f, 3), 1, HOT_SCHEMA), ["k"],
                           "ts", window, HOT_SCHEMA)
    got = sorted(r.event_id for r in ST.run_to_table(spark, s, "t-hot-dedup").collect())
    us = ST.epoch_us(F.col("ts"))
    gap = us - F.lag(us).over(Window.partitionBy("k").orderBy("ts"))
    want = f.withColumn("g", gap).filter(F.col("g").isNull() | (F.col("g") >= window * 1e6))
    assert got == sorted(r.event_id for r in want.collect())


def test_stream_debounce_splits_a_hot_key_of_one_batch(spark):
    f = hot_feed(spark).filter("k = 'hot' and ts is not null")
    s = ST.stream_debounce(ST.read_feed(spark, land_in_slices(spark, f, 1), None, HOT_SCHEMA),
                           ["k"], "ts", 60.0, HOT_SCHEMA)
    q = (s.writeStream.format("noop").option("checkpointLocation", ST.scratch(spark, "t-hot-ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    states = max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators)
    assert states >= 30                      # one per hour of the feed; a single one before


KEY = lambda r: (r.table, r.row_id, r.event_id)


def run_stream(spark, f, out, ck, **more):
    path = ST.land_feed(f, ST.scratch(spark, "t-land"), files=3)
    ST.stream_vectorize(spark, ST.read_feed(spark, path, 1), derive.routing_config(spark), out, ck,
                        8, "m", **more).awaitTermination()


def test_a_new_checkpoint_on_the_same_sink_loses_nothing(spark):
    f, out = feed(spark), ST.scratch(spark, "t-two")
    for part in (0, 1):
        run_stream(spark, f.filter(F.col("event_id") % 2 == part), out,
                   ST.scratch(spark, "t-two-ck"))
    whole = ST.scratch(spark, "t-one")
    run_stream(spark, f, whole, ST.scratch(spark, "t-one-ck"))
    assert sorted(map(KEY, ST.current_vectors(spark, out).collect())) == \
        sorted(map(KEY, ST.current_vectors(spark, whole).collect())) != []
    rejects = spark.read.parquet(f"{out}/rejects")
    from vecsync.sources.feed import feed_rejects
    assert rejects.count() == feed_rejects(f).count() > 0


def test_compaction_then_new_batches(spark):
    f, out = feed(spark), ST.scratch(spark, "t-vec5")
    snaps = [ST.scratch(spark, "t-snap") for _ in range(2)]
    for part in range(3):
        run_stream(spark, f.filter(F.col("event_id") % 3 == part), out,
                   ST.scratch(spark, f"t-ck{part}"))
        plain = sorted(map(KEY, ST.current_vectors(spark, out).collect()))
        if part:
            assert sorted(map(KEY, ST.current_vectors(spark, out, snaps[part - 1]).collect())) \
                == plain
        if part < 2:
            ST.compact_vectors(spark, out, snaps[part], snaps[part - 1] if part else None)
    empty = ST.scratch(spark, "t-none")
    assert ST.current_vectors(spark, empty).count() == 0
    left = ST.current_vectors(spark, out, snaps[1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in left and "batch_id" in left


def test_retries_until_dead(spark):
    out = ST.scratch(spark, "t-retry")
    run_stream(spark, feed(spark), out, ST.scratch(spark, "t-retry-ck"), provider="faulty",
               modulus=10, dead=0, busy=6)
    tries = ST.attempts(spark, out)
    kinds = {r.outcome: r["count"] for r in tries.groupBy("outcome").count().collect()}
    assert set(kinds) == {"success", "retry"}
    start = ST.dead_letters(spark, out).count()
    again = dict(dimension=8, model="m", provider="faulty", modulus=10, dead=0, busy=6)
    assert ST.run_retries(spark, out, "1999-01-01 00:00:00", **again) == 0
    waiting = ST._latest_attempts(spark, out).filter("outcome = 'retry'").count()
    late = "2199-01-01 00:00:00"
    for _ in range(4):                                  # three retries, then given up
        assert ST.run_retries(spark, out, late, **again) == waiting
    assert ST.run_retries(spark, out, late, **again) == 0
    assert ST.dead_letters(spark, out).count() == start + waiting
    # a provider that is well again: the next retry gives vectors
    mended = ST.scratch(spark, "t-retry2")
    run_stream(spark, feed(spark), mended, ST.scratch(spark, "t-retry2-ck"), provider="faulty",
               modulus=10, dead=0, busy=6)
    before = ST.current_vectors(spark, mended).count()
    n = ST.run_retries(spark, mended, late, 8, "m")
    assert n == waiting and ST.current_vectors(spark, mended).count() >= before
