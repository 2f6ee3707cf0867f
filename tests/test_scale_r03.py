"""What grew faster than the input, or with the wrong thing, in round 3."""
import tracemalloc

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from vecsync.functions import clean as C
from vecsync.operators import ivf as IVF
from vecsync.operators import packing as PK
from vecsync.operators import routing as R
from vecsync.operators import waves as WV
from vecsync.operators.embed import embed_column
from vecsync.plans import derive
from vecsync.sources import outbox as OB
from vecsync.streaming import jobs as ST
from vecsync.streaming import retries as RT

FEED = "event_id long, k string, ts timestamp_ntz"


def _progress(query, what):
    return max(getattr(o, what) for p in query.recentProgress for o in p.stateOperators)


def test_debounce_state_grows_with_time_and_not_with_keys(spark):
    """2,000 keys of one hour share a few groups; over several batches the rows are those
    of the plain window."""
    f = spark.range(6_000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 2000 != 0, F.concat(
            F.lit("k"), F.col("id") % 2000)).alias("k"),
        F.timestamp_seconds(1_704_067_200 + F.floor(F.col("id") / 2000) * 700
                            + F.col("id") % 7).cast("timestamp_ntz").alias("ts"))
    path = ST.scratch(spark, "t-r03")
    for n in range(3):
        f.filter(F.floor(F.col("event_id") / 2000) == n).coalesce(1).write.mode(
            "append").parquet(path)
    s = ST.stream_debounce(ST.read_feed(spark, path, 1, FEED), ["k"], "ts", 900.0, FEED)
    out = ST.scratch(spark, "t-r03-out")
    q = (s.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ST.scratch(spark, "t-r03-ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert _progress(q, "numRowsTotal") <= 16
    gap = ST.epoch_us(F.col("ts")) - F.lag(ST.epoch_us(F.col("ts"))).over(
        Window.partitionBy("k").orderBy("ts"))
    want = f.withColumn("g", gap).filter(F.col("g").isNull() | (F.col("g") >= 900 * 1_000_000))
    got = sorted(r.event_id for r in spark.read.parquet(out).collect())
    assert got == sorted(r.event_id for r in want.collect())


def _plan(df):
    return df._jdf.queryExecution().toString()


def _no_small_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def test_rows_of_a_target_do_not_meet_to_be_routed(spark):
    """The routing table is sent to the rows, whatever the planner knows of its size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    _no_small_joins(spark)
    try:
        rows = spark.range(10).selectExpr(
            "if(id < 0, 'x', 'appdb') database", "if(id < 0, 'x', 'public') schema",
            "if(id < 0, 'x', 'documents') table", "id")
        got = R.route_events(rows, derive.routing_config(spark))
        assert "BroadcastHashJoin" in _plan(got) and got.count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_texts_of_the_preset_reach_the_tokenizer(spark):
    """a text that is not HTML by its config is none of the tokenizer's."""
    text = "a &hellip; b <nav>x</nav> <b"
    df = spark.createDataFrame([(text, "basic_text"), (text, "html_to_text")], "t string, p string")
    got = df.select(R.clean_by_config(F.col("t"), F.lit(True), F.col("p")).alias("c"))
    assert [r.c for r in got.collect()] == [text, "a … b <b"]
    udf = [x for x in _plan(got).splitlines() if "ArrowEvalPython" in x][-1]
    assert "p#" in udf


def test_texts_without_markup_pass_the_html_patterns_by(spark):
    """they are asked for "<" and "&" first."""
    df = spark.createDataFrame([("a  b",), ("a &amp; <i>b</i>",), ("x < y &copy",), (None,)],
                               "t string")
    got = df.select(C.html_text(F.col("t")).alias("c"))
    assert [r.c for r in got.collect()] == ["a  b", "a & b", "x < y ©", ""]
    assert "Contains(" in _plan(got)


def test_rows_of_a_target_do_not_meet_to_be_packed(spark):
    """the number of a target's groups is looked up by target and salt, without texts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    _no_small_joins(spark)
    try:
        df = spark.range(2_000).selectExpr(
            "if(id % 50 = 0, null, 'one') b", "cast(id as string) id",
            "if(id % 7 = 0, null, repeat('x', cast(id % 90 as int))) t")
        got = PK.pack_requests(df, "id", "t", 8, 40, ["b"])
        assert "_salt" in _plan(got)
        rows = got.collect()
        assert len(rows) == 2_000 and all((r.request is None) == (r.t is None) for r in rows)
        assert len({(r.b, r.request) for r in rows if r.request}) == len(
            {r.request for r in rows if r.request})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_packed_texts_are_embedded_a_few_requests_at_a_time(spark):
    """record batches are cut between requests, and only a cut is Python objects."""
    df = spark.range(3_000).selectExpr("id", "if(id % 11 = 0, null, concat('t', id)) t")
    got = PK.embed_requests(PK.pack_requests(df, "id", "t", 8, 40), "t", max_tasks=1, dimension=4)
    assert "MapInArrow" in _plan(got)
    want = {r.id: r.v for r in embed_column(df, "t", "v", "mock", dimension=4).collect()}
    rows = got.collect()
    assert {r.id: r.vector for r in rows} == want and len(rows) == 3_000
    assert {(r.t is None, r.outcome, r.sent) for r in rows} == {
        (True, "skipped", 0), (False, "success", 1)}


def test_a_wave_opens_its_own_slots_only(spark):
    """pending rows lie in folders of slots; the counts come from the wave's own job."""
    df = spark.range(900).selectExpr("id", "concat('t', id) t")
    path = ST.scratch(spark, "t-waves")
    got, waves = WV.embed_in_waves(df, "id", "t", path, "throttled", start=6, rows_per_task=10,
                                   limit=4, dimension=4)
    assert got.count() == 900 and got.filter("vector is null").count() == 0
    assert waves.filter("pass = 0").agg(F.sum("rows")).first()[0] == 900
    blocks = spark.read.parquet(f"{path}/pending/pass=0")
    assert "block" in blocks.columns and blocks.select("block").distinct().count() > 1
    assert waves.agg(F.sum("rows")).first()[0] == 900 + waves.agg(F.sum("refused")).first()[0]


def test_rows_are_set_against_queries_a_few_at_a_time():
    """20,000 rows and 2,000 queries are 320 MB at once."""
    r, away = np.linspace(0, 9, 20_000), np.linspace(3, 4, 2_000)
    limit = np.full(2_000, 0.5)
    tracemalloc.start()
    near = IVF._near(r, away, limit, 1_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6 and (near == ((r >= 2.5) & (r <= 4.5))).all()


def test_an_outbox_has_small_row_groups(spark):
    """a range of ids reads whole row groups."""
    import glob

    import pyarrow.parquet as pq
    feed = spark.range(60_000).selectExpr(
        "id event_id", "timestamp_ntz '2024-01-01 00:00:00' ts",
        "concat(sha2(cast(id as string), 512), sha2(cast(id + 1 as string), 512)) value")
    path = ST.scratch(spark, "t-outbox")
    assert OB.append_outbox(feed, path) == 60_000
    meta = [pq.read_metadata(f) for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet")]
    groups = [m.row_group(i) for m in meta for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 60_000
    assert max(g.total_byte_size for g in groups) < 4 << 20


def test_a_group_has_one_timer_for_all_its_keys(spark):
    """2,000 keys wait in the state of a few hundred groups, and all come back once."""
    rows = spark.range(2_000).selectExpr(
        "id k", "id event_id", "timestamp_ntz '2024-01-01 00:00:00' ts", "0 retry_count",
        "'retry' outcome", "timestamp_ntz '2024-01-01 00:00:00' failed_at")
    path, out = ST.scratch(spark, "t-in"), ST.scratch(spark, "t-out")
    rows.coalesce(1).write.parquet(path)
    rows.limit(1).selectExpr("-1L k", "-1L event_id", "ts", "retry_count", "'success' outcome",
                             "failed_at + interval 1 day failed_at").write.mode(
        "append").parquet(path)
    store = spark.conf.get(RT.PROVIDER, None)
    try:
        due = RT.retry_timers(spark.readStream.schema(rows.schema).parquet(path), ["k"], "ts",
                              "event_id", "failed_at", 5.0, 3)
        q = (due.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ST.scratch(spark, "t-ck"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(RT.PROVIDER, store) if store else spark.conf.unset(RT.PROVIDER)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == list(range(2_000))
    assert _progress(q, "numRowsTotal") < 2_000


def test_log_rows_clean_and_embed_a_row_once(spark):
    """no filter repeats the cleaning and the embedding of the rows."""
    from support import SF001
    from vecsync.plans.registry import QUERIES

    plan = QUERIES["vectorization_log_rows"](spark, SF001)._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("regexp_replace(") == 2


def test_cached_embedding_reads_a_text_once(spark):
    """what ``df`` does to its texts is done once for each row of a run."""
    from vecsync.operators import vector_cache as VC

    seen = spark.sparkContext.accumulator(0)

    def shout(t):
        seen.add(1)
        return t.upper()

    cache = VC.VectorCache.create(spark, ST.scratch(spark, "t-r03-cache"), parts=4, bits=1 << 12)
    df = spark.range(200).select("id", F.udf(shout, "string")(
        F.concat(F.lit("text "), F.col("id") % 50)).alias("t"))
    got = VC.embed_cached(df, "id", "t", cache, ST.scratch(spark, "t-r03-run"), "m", 8)
    assert got.filter("outcome = 'success' and sent = 1").count() == 200
    assert seen.value == 200


def test_basic_clean_is_the_plain_cleaner_for_every_character(spark):
    """the shorter patterns against the sets they stand for."""
    chars = [chr(c) for c in range(1, 0x3100)] + ["\ufeff", "\U0001f600"]
    texts = [f"a{c}{c}b {c} \x00{c}" for c in chars]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace(F.trim(F.regexp_replace("t", C.WS + "+", " ")), C.CTRL, "")
    assert df.filter(C.basic_clean(F.col("t")) != plain).count() == 0
