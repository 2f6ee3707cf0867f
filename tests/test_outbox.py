"""The outbox source: commit ids as offsets, nothing lost or repeated over restarts."""
import json
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from support import SF001
from vecsync.plans import derive
from vecsync.sources import outbox
from vecsync.streaming.jobs import scratch


def run(stream, out, ck):
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
     .trigger(availableNow=True).start().awaitTermination())


def events(spark):
    return derive.change_feed(spark.read.parquet(f"{SF001}/events.parquet"))


def rows(df):
    return Counter(map(tuple, df.select("event_id", "ts", "value").collect()))


def test_restarts_neither_lose_nor_repeat(spark):
    feed, table = events(spark), scratch(spark, "t-outbox")
    out, ck = scratch(spark, "t-out"), scratch(spark, "t-ck")
    last, n = 0, feed.count()
    for k in range(3):
        last = outbox.append_outbox(feed.filter(F.col("event_id") % 3 == k), table, last)
        run(outbox.read_feed_outbox(spark, path=table, rows_per_partition=97), out, ck)
        assert spark.read.parquet(out).count() == last
        run(outbox.read_feed_outbox(spark, path=table), out, ck)     # nothing new
    assert last == n and rows(spark.read.parquet(out)) == rows(feed)
    ids = spark.read.parquet(table).select("commit_id").agg(
        F.min("commit_id"), F.max("commit_id"), F.count_distinct("commit_id")).first()
    assert tuple(ids) == (1, n, n)


def test_an_unfinished_batch_is_read_again_as_it_was(spark):
    """A batch that fails after it was planned: the next run has its rows once, then the rest."""
    feed, table = events(spark), scratch(spark, "t-outbox")
    ck, seen = scratch(spark, "t-ck"), []
    last = outbox.append_outbox(feed.filter("event_id % 2 = 0"), table)

    def broken(batch, n):
        raise RuntimeError("lost")

    def kept(batch, n):
        seen.append((n, rows(batch)))

    def start(sink):
        return (outbox.read_feed_outbox(spark, path=table).writeStream.foreachBatch(sink)
                .option("checkpointLocation", ck).trigger(availableNow=True).start())

    with pytest.raises(Exception, match="lost"):
        start(broken).awaitTermination()
    outbox.append_outbox(feed.filter("event_id % 2 = 1"), table, last)
    for _ in range(2):                                  # the unfinished one, then what is new
        start(kept).awaitTermination()
    assert [n for n, _ in seen] == [0, 1]
    assert seen[0][1] == rows(feed.filter("event_id % 2 = 0"))
    assert seen[1][1] == rows(feed.filter("event_id % 2 = 1"))


def test_a_batch_is_cut_into_ranges_of_its_files(spark):
    table = scratch(spark, "t-outbox")
    outbox.append_outbox(events(spark).limit(1000), table)
    reader = outbox.OutboxReader({"path": table, "rowspartition": "1", "rowsperpartition": "64"})
    parts = reader.partitions({"commit_id": 100}, {"commit_id": 700})
    ids = [r for p in parts for b in reader.read(p) for r in b["commit_id"].to_pylist()]
    assert sorted(ids) == list(range(101, 701)) and len(parts) >= 600 / 64
    assert all(p.end - p.start <= 64 for p in parts)
    assert reader.latestOffset() == {"commit_id": 1000}
    empty = outbox.OutboxReader({"path": scratch(spark, "not-there"), "after": "5"})
    assert empty.initialOffset() == empty.latestOffset() == {"commit_id": 5}


def test_a_table_of_a_database(spark, tmp_path):
    file = str(tmp_path / "outbox.db")
    own = sqlite3.connect(file)
    own.execute("CREATE TABLE changes (commit_id INTEGER PRIMARY KEY, event_id INTEGER, ts TEXT, "
                "value TEXT)")
    out, ck = scratch(spark, "t-out"), scratch(spark, "t-ck")

    def stream(**more):
        return outbox.read_feed_outbox(spark, module="sqlite3", table="changes",
                                       connect=json.dumps({"database": file}),
                                       rows_per_partition=10, **more)

    at = 0
    for _ in range(2):
        own.executemany("INSERT INTO changes VALUES (?, ?, ?, ?)",
                        [(i, 1000 + i, "2024-01-02 03:04:05.000006", None if i % 7 == 0
                          else f"v{i}") for i in range(at + 1, at + 36)])
        own.commit()
        at += 35
        run(stream(), out, ck)
        got = spark.read.parquet(out).orderBy("event_id").collect()
        assert [r.event_id for r in got] == list(range(1001, 1001 + at))
    assert got[6].value is None and got[0].value == "v1" and got[0].ts.microsecond == 6
    later, ck2 = scratch(spark, "t-out"), scratch(spark, "t-ck")
    run(stream(after=60), later, ck2)
    assert spark.read.parquet(later).count() == 10
    own.close()
    with pytest.raises(ValueError):
        outbox._Database({"table": "x; DROP TABLE y"})
