"""Retries by timer: state, timers, replays, the running loop."""
import time

import pytest
from pyspark.sql import functions as F

from support import SF001
from vecsync.plans import derive
from vecsync.streaming import jobs as ST
from vecsync.streaming import retries as RT

KIND = ("k string, event_id long, ts timestamp_ntz, retry_count int, outcome string, "
        "failed_at timestamp_ntz")


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get(RT.PROVIDER, None)
    yield
    spark.conf.set(RT.PROVIDER, before) if before else spark.conf.unset(RT.PROVIDER)


def row(spark, k, event, minute, count, outcome="retry", ts="2024-01-01 00:00:00"):
    return spark.sql(f"SELECT '{k}' AS k, {event}L AS event_id, TIMESTAMP_NTZ '{ts}' AS ts, "
                     f"{count} AS retry_count, '{outcome}' AS outcome, TIMESTAMP_NTZ "
                     f"'2024-01-01 00:00:00' + INTERVAL {minute} MINUTES AS failed_at")


def play(spark, batches, **more):
    """One micro-batch for each list of rows: what came out of each, and state rows at the end."""
    path, ck, seen = ST.scratch(spark, "t-in"), ST.scratch(spark, "t-ck"), []
    for i, rows in enumerate(batches):
        df = rows[0]
        for r in rows[1:]:
            df = df.unionByName(r)
        df.select(*[F.col(f.split()[0]) for f in KIND.split(", ")]).coalesce(1).write.mode(
            "append").parquet(path)
        stream = spark.readStream.schema(KIND).parquet(path)
        due = RT.retry_timers(stream, ["k"], "ts", "event_id", "failed_at", 60.0, 3,
                              delay="30 seconds", **more)
        q = (due.writeStream.option("checkpointLocation", ck).trigger(availableNow=True)
             .foreachBatch(lambda b, n: seen.extend((i, *r) for r in b.select(
                 "k", "decision", "retry_count", "event_id").collect())).start())
        q.awaitTermination()
    return sorted(seen), q.recentProgress[-1].stateOperators[0].numRowsTotal


def test_due_once_dead_and_state_ends(spark):
    r = lambda *a, **b: row(spark, *a, **b)
    seen, left = play(spark, [
        [r("a", 1, 0, 0), r("b", 2, 0, 2), r("c", 3, 0, 3)],       # due at minutes 1, 4, dead
        [r("a", 1, 0, 0), r("z", 9, 2, 0, "success")],             # a repeat; minute 2 passes
        [r("z", 9, 3, 0, "success")],
        [r("a", 1, 3, 1), r("z", 9, 30, 0, "success")],            # fails again: due at 5
        [r("a", 1, 30, 2, "success"), r("b", 2, 30, 3), r("z", 9, 40, 0, "success")]])
    assert seen == [(0, "c", "dead", 3, 3), (1, "a", "retry", 1, 1),
                    (3, "a", "retry", 2, 1), (3, "b", "retry", 3, 2), (4, "b", "dead", 3, 2)]
    assert left == 0


def test_a_newer_event_replaces_what_waits(spark):
    r = lambda *a, **b: row(spark, *a, **b)
    later = "2024-01-01 00:00:30"
    seen, _ = play(spark, [
        [r("a", 1, 0, 0)], [r("a", 5, 0, 0, ts=later)], [r("a", 1, 0, 1)],
        [r("z", 9, 60, 0, "success")]])
    assert seen == [(3, "a", "retry", 1, 5)]


def test_what_gets_no_outcome_is_forgotten(spark):
    r = lambda *a, **b: row(spark, *a, **b)
    seen, left = play(spark, [
        [r("a", 1, 0, 0)], [r("z", 9, 5, 0, "success")], [r("z", 9, 100, 0, "success")],
        [r("z", 9, 101, 0, "success")]], forget_ms=60_000)
    assert [x[:3] for x in seen] == [(1, "a", "retry")] and left == 0


def test_the_loop_runs_until_rows_are_done_or_dead(spark):
    """A provider that never mends: three retries each, once, then the dead letters (S7); one
    that is well again gives vectors.  Stopped and started again on the way."""
    feed = derive.change_feed(spark.read.parquet(f"{SF001}/events.parquet"))
    path = ST.land_feed(feed, ST.scratch(spark, "t-feed"), 2)

    def vectorized():
        out = ST.scratch(spark, "t-retry-loop")
        ST.stream_vectorize(spark, ST.read_feed(spark, path), derive.routing_config(spark), out,
                            ST.scratch(spark, "t-ck"), 8, "m", provider="faulty", modulus=10,
                            dead=0, busy=6).awaitTermination()
        return out, ST._latest_attempts(spark, out).filter("outcome = 'retry'").count()

    def drive(out, done, **provider):
        ck = ST.scratch(spark, "t-ck")
        for limit in (4, 420):                          # stopped early, then to the end
            q = RT.run_retry_stream(spark, out, ck, 8, "m", retry_delay=0.5, max_retries=3,
                                    trigger={"processingTime": "1 second"}, **provider)
            stop = time.time() + limit
            while time.time() < stop and not done() and q.isActive:
                time.sleep(1)
            q.stop()
            assert q.exception() is None

    out, waiting = vectorized()
    assert waiting > 0
    drive(out, lambda: ST.dead_letters(spark, out).count() >= waiting, provider="faulty",
          modulus=10, dead=0, busy=6)
    assert ST.dead_letters(spark, out).count() == waiting
    tries = (ST.attempts(spark, out).filter("run like 'retry-%'")
             .groupBy("table", "row_id", "event_id", "retry_count").count())
    assert tries.filter("count > 1").count() == 0
    assert tries.groupBy("retry_count").count().count() == 4        # 1, 2, 3 and dead
    out, waiting = vectorized()
    before = ST.attempts(spark, out).filter("outcome = 'success'").count()
    drive(out, lambda: ST.attempts(spark, out).filter("outcome = 'success'").count()
          >= before + waiting)
    assert ST.attempts(spark, out).filter("outcome = 'success'").count() == before + waiting
    assert ST._latest_attempts(spark, out).filter("outcome <> 'success'").count() == 0
