"""Date-partitioned log, claims of retries, Kafka rows."""
from pyspark.sql import functions as F

from support import SF001
from vecsync.operators import writeback as WB
from vecsync.plans import derive
from vecsync.sources import feed as FD
from vecsync.streaming import jobs as ST


def log(spark):
    return derive.vectorization_log(spark.read.parquet(f"{SF001}/events.parquet"))


def test_a_replayed_batch_replaces_its_own_rows_only(spark):
    rows, path = log(spark), ST.scratch(spark, "t-log")
    days = sorted(r[0] for r in rows.select(F.to_date("created_at")).distinct().collect())
    cut = days[len(days) // 2]
    early = F.to_date("created_at") <= F.lit(cut)           # both batches have rows of a day
    first, second = rows.filter(early), rows.filter(~early).unionByName(
        rows.filter(F.to_date("created_at") == F.lit(cut)).limit(3))
    for batch, part in ((0, first), (1, second), (1, second), (0, first)):
        WB.append_log(part, path, batch)
    got = WB.read_log(spark, path)
    assert got.count() == rows.count() + 3
    want = {(r[0], r[1]) for r in first.unionByName(second).groupBy(F.to_date("created_at"))
            .count().collect()}
    assert {(r[0], r[1]) for r in got.groupBy("log_date").count().collect()} == want
    some = WB.read_log(spark, path, str(cut), str(cut))
    assert "PartitionFilters: [" in some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == dict(want)[cut]
    odd = first.limit(2).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    WB.append_log(odd, path, 7)
    assert WB.read_log(spark, path).filter("log_date IS NULL").count() == 2


def vectorized(spark, **bad):
    feed = derive.change_feed(spark.read.parquet(f"{SF001}/events.parquet"))
    path, out = ST.land_feed(feed, ST.scratch(spark, "t-feed"), 2), ST.scratch(spark, "t-out")
    ST.stream_vectorize(spark, ST.read_feed(spark, path), derive.routing_config(spark), out,
                        ST.scratch(spark, "t-ck"), 8, "m", **bad).awaitTermination()
    return out


LATE = "2199-01-01 00:00:00"


def test_claimed_rows_are_left_to_the_run_that_has_them(spark):
    bad = dict(provider="faulty", modulus=10, dead=0, busy=6)
    out = vectorized(spark, **bad)
    waiting = ST._latest_attempts(spark, out).filter("outcome = 'retry'")
    n = waiting.count()
    half = waiting.filter(F.col("event_id") % 2 == 0).select(
        "event_id", "ts", "table", "row_id", "clean",
        (F.col("retry_count") + 1).alias("retry_count"))
    taken = half.count()
    assert 0 < taken < n
    # another run wrote its claim and has not come back
    half.withColumn("claimed_at", F.current_timestamp()).write.parquet(
        f"{out}/claims/run=retry-another")
    assert ST.run_retries(spark, out, LATE, 8, "m") == n - taken
    left = ST._latest_attempts(spark, out).filter("outcome = 'retry'")
    assert left.count() == taken and left.filter("event_id % 2 = 1").count() == 0
    assert ST.run_retries(spark, out, LATE, 8, "m") == 0
    # its lease is over: the rows are sent by the next run, once
    assert ST.run_retries(spark, out, LATE, 8, "m", lease_seconds=0.0) == taken
    assert ST._latest_attempts(spark, out).filter("outcome = 'retry'").count() == 0
    tries = ST.attempts(spark, out).groupBy(*ST.RETRY_KEY).count()
    assert tries.filter("count > 1").count() == 0


def test_a_finished_claim_does_not_hold_back_the_next_retry(spark):
    bad = dict(provider="faulty", modulus=10, dead=0, busy=6)
    out = vectorized(spark, **bad)
    n = ST._latest_attempts(spark, out).filter("outcome = 'retry'").count()
    assert [ST.run_retries(spark, out, LATE, 8, "m", **bad) for _ in range(5)] == [n] * 4 + [0]


def test_kafka_rows_become_feed_events(spark):
    """Rows as the Kafka source gives them: binary payloads, partition and offset, a time."""
    feed = derive.change_feed(spark.read.parquet(f"{SF001}/events.parquet")).limit(200)
    raw = feed.select(
        F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value"),
        F.lit("changes").alias("topic"), (F.col("event_id") % 3).cast("int").alias("partition"),
        F.floor(F.col("event_id") / 3).cast("long").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"))
    got = FD.kafka_events(raw)
    assert got.columns == ["event_id", "ts", "value"]
    assert got.select("event_id").distinct().count() == 200
    assert {r.event_id >> 40 for r in got.collect()} == {0, 1, 2}
    assert sorted(r.value for r in got.collect()) == sorted(r.value for r in feed.collect())
    assert FD.parse_feed(got).count() == FD.parse_feed(feed).count()
    assert dict(got.dtypes)["ts"] == "timestamp_ntz"
