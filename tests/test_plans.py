"""Physical-plan properties the scale design relies on."""
import re

import pytest

import __spark_entry__ as E
from support import SF001


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def q():
    return E.queries()


def test_look_back_is_pushed_to_parquet_and_pruned(spark, q):
    p = plan(q["recent_log"](spark, SF001))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in p
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in p
    assert len(re.findall(r"^\(\d+\) Scan parquet", p, re.M)) == 1


def test_text_scan_reads_two_columns(spark, q):
    p = plan(q["scan_text_table"](spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_routing_is_a_broadcast_join(spark, q):
    p = plan(q["route_events"](spark, SF001))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_latest_per_key_limits_before_the_shuffle(spark, q):
    p = plan(q["latest_event"](spark, SF001))
    assert p.count("WindowGroupLimit") >= 2   # partial (map side) + final


def test_cleaners_are_codegen_not_python(spark, q):
    p = plan(q["clean_markdown"](spark, SF001))
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    assert "WholeStageCodegen" in p or "codegen id" in p


def test_knn_has_no_cartesian_product(spark, q):
    p = plan(q["knn_exact"](spark, SF001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_health_rollup_has_no_cross_join(spark, q):
    p = plan(q["system_health_full"](spark, SF001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_bucketed_snapshots_diff_without_shuffle(spark):
    from vecsync.operators.detect import snapshot_diff
    from vecsync.operators.writeback import write_bucketed_snapshot
    from vecsync.plans import derive
    from vecsync.sources.tables import read_table
    docs = read_table(spark, SF001, "documents")
    old = derive.old_snapshot(docs, read_table(spark, SF001, "benchmark"))
    write_bucketed_snapshot(docs.select("doc_id", "text"), "snap_new", "doc_id", 8)
    write_bucketed_snapshot(old, "snap_old", "doc_id", 8)
    diff = snapshot_diff(spark.table("snap_old"), spark.table("snap_new"), "doc_id", "text")
    p = plan(diff)
    assert "SortMergeJoin" in p and "Exchange" not in p
    eager = snapshot_diff(old, docs, "doc_id", "text")
    key = lambda r: (r.doc_id, r.operation)
    assert sorted(map(key, diff.collect())) == sorted(map(key, eager.collect()))


def test_flagship_ships_only_cleaned_text_to_python(spark, q):
    p = plan(q["completion_after_backfill"](spark, SF001))
    sections = re.split(r"\n(?=\(\d+\) )", p)
    arrow = [s for s in sections if re.match(r"\(\d+\) MapInPandas", s)]
    assert arrow, "embedding runs in an Arrow task"
    inputs = re.search(r"Input \[\d+\]: \[(.*)\]", arrow[0]).group(1)
    assert "text_vector" not in inputs and "embedding" not in inputs and "text#" not in inputs


def test_debounce_is_one_scan_one_shuffle_no_join(spark, q):
    p = plan(q["debounce_events"](spark, SF001))
    assert len(re.findall(r"^\(\d+\) Scan parquet", p, re.M)) == 1
    assert len(re.findall(r"^\(\d+\) Exchange", p, re.M)) == 1 and "Join" not in p


def test_exact_percentile_is_not_one_buffer(spark, q):
    assert "percentile" not in plan(q["system_health_full"](spark, SF001)).replace(
        "p95_processing_time_ms", "")


def test_status_stream_in_several_batches_ends_its_state(spark):
    from pyspark.sql import functions as F
    from vecsync.plans import derive
    from vecsync.streaming import jobs as ST
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    path = ST.scratch(spark, "t-days")
    days = [r[0] for r in ev.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    for i, d in enumerate(days):                        # one file a day, in order
        ev.filter(F.to_date("ts") == d).coalesce(1).write.parquet(f"{path}/n={i:03d}")
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
              .parquet(path))
    s = ST.stream_daily_status(derive.vectorization_log(stream), "0 seconds")
    seen = []
    q = (s.writeStream.outputMode("update").option("checkpointLocation", ST.scratch(spark, "t-ck"))
         .foreachBatch(lambda b, n: seen.append(b.count())).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = [op.numRowsTotal for p in q.recentProgress for op in p.stateOperators]
    closed = sum(op.numRowsRemoved for p in q.recentProgress for op in p.stateOperators)
    assert len(days) > 3 and closed > 0 and max(rows) < sum(seen)
