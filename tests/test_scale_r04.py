"""F1 of round 4: what the waves do beside each other, on rows of the tests' own."""
import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from vecsync.operators import waves as WV
from vecsync.operators.embed import embed_outcomes
from vecsync.streaming import jobs as ST


def test_waves_send_every_row_and_keep_none(spark):
    """Waves over several groups of slots, some of more tasks than take whole parts; ids are NULL
    or come again.  Their outcomes were written in a folder for each wave."""
    df = spark.range(2_000).selectExpr("if(id % 100 = 7, null, id % 1900) id",
                                       "if(id % 90 = 1, null, concat('t', id)) t")
    path = ST.scratch(spark, "t-waves")
    got, waves = WV.embed_in_waves(df, "id", "t", path, "throttled", start=12, rows_per_task=10,
                                   limit=4, dimension=4)
    want = embed_outcomes(df, "t", "mock", dimension=4)
    row = ["id", F.col("vector").cast("string"), "outcome", "message"]
    assert got.select(*row).exceptAll(want.select(*row)).count() == 0
    assert want.select(*row).exceptAll(got.select(*row)).count() == 0
    log = waves.orderBy("wave").collect()
    assert [w.wave for w in log] == list(range(len(log)))
    for a, b in zip(log, log[1:]):
        assert b.concurrency == WV.next_concurrency(a.concurrency, a.refused, 64)
    for turn in {w["pass"] for w in log}:
        own = [w for w in log if w["pass"] == turn]
        sent = spark.read.parquet(f"{path}/tried/pass={turn}")
        assert sum(w.rows for w in own) == sent.count()
        assert sum(w.refused for w in own) == sent.filter("outcome = 'retry'").count()
        folders = [x for x in os.listdir(f"{path}/tried/pass={turn}") if x.startswith("wave=")]
        assert len(folders) == -(-len(own) // WV.WRITTEN)       # was one for each wave
    kept = spark.sparkContext._jsc.sc().getRDDStorageInfo()
    assert sum(x.numCachedPartitions() for x in kept) == 0


def test_a_small_wave_takes_whole_parts(spark):
    """The rows of a group of slots are dealt once: a wave of a few tasks has no shuffle."""
    place = ST.scratch(spark, "t-slots")
    (spark.range(3_000).selectExpr("id", "cast(id % 150 as int) slot",
                                   "cast(id % 150 div 16 as int) block")
     .write.partitionBy("block").parquet(place))
    with ThreadPoolExecutor(1) as pool:
        slots = WV._Slots(spark.read.parquet(place), 150, pool)
        for at, tasks in ((60, 6), (62, 12), (148, 4)):
            slots.hold(at, at + tasks)
            rows = slots.take(at, tasks)
            plan = rows._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")
            assert f"Repartition {tasks}, {str(tasks > 8).lower()}" in plan[0]
            assert rows.rdd.getNumPartitions() == tasks
            assert {r.slot for r in rows.collect()} == set(range(at, min(at + tasks, 150)))
            each = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(each) == 20 * min(tasks, 150 - at)
        for group in list(slots.groups):
            slots.drop(group)


def test_waves_of_empty_slots(spark):
    """More slots than rows' hashes fall into, and fewer rows than tasks."""
    df = spark.range(9).selectExpr("id", "concat('t', id) t")
    got, waves = WV.embed_in_waves(df, "id", "t", ST.scratch(spark, "t-waves"), "throttled",
                                   start=3, rows_per_task=1, limit=2, dimension=4)
    assert got.count() == 9 and got.filter("outcome = 'success'").count() == 9
    assert waves.agg(F.sum("rows") - F.sum("refused")).first()[0] == 9
    got, _ = WV.embed_in_waves(df, "id", "t", ST.scratch(spark, "t-waves"), start=1,
                               rows_per_task=1, most=1, dimension=4)
    assert {r.id for r in got.collect()} == set(range(9))


def test_a_task_tells_its_rows_and_refusals(spark):
    counts = spark.sparkContext.accumulator({}, WV.WaveCounts())
    df = spark.range(30).selectExpr("id", "concat('t', id) t").repartition(3)
    embed_outcomes(df, "t", "throttled", at_end=lambda n, refused: counts.add({5: (1, n, refused)}),
                   limit=2, dimension=4).collect()
    tasks, rows, refused = counts.value[5]
    assert (tasks, rows) == (3, 30) and 0 < refused < 30
