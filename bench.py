"""Benchmark: headline stages at $BENCH_SF_DIR on local[$BENCH_CPUS].

All stages run once to warm up (JIT, Python workers), then once more timed.  Results
are forced with the ``noop`` sink (full evaluation, nothing collected) or a
small ``collect`` for roll-ups.  Prints ONE JSON line.
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def sf_of(path: str) -> float:
    base = os.path.basename(path.rstrip("/"))
    try:
        return float(base.replace("sf", ""))
    except ValueError:
        return -1.0


def main():
    from vecsync.functions import clean as C
    from vecsync.functions.vectors import mock_embedding
    from vecsync.operators import embed as EM
    from vecsync.operators import knn as KN
    from vecsync.plans import backfill, derive, registry as RG
    from vecsync.session import get_spark
    from vecsync.sources.tables import TABLES, read_table
    from vecsync.streaming import jobs as ST

    extra = {}
    if os.environ.get("BENCH_EVENT_LOG"):   # stage / task times for offline reading
        extra = {"spark.eventLog.enabled": "true",
                 "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]}
    spark = get_spark(f"local[{CPUS}]", int(CPUS), extra=extra)
    # the given tables are one row group each; a copy in as many files as there are cores lets
    # scans, cleaners and embedders use all of them
    d = ST.scratch(spark, "bench-input")
    for t in TABLES:
        n = int(CPUS) if t in ("documents", "events", "pages", "embeddings") else 1
        read_table(spark, SF_DIR, t).repartition(n).write.parquet(f"{d}/{t}.parquet")
    docs = read_table(spark, d, "documents")
    pages = read_table(spark, d, "pages")
    n_docs = docs.count()
    n_pages = pages.count()
    n_events = read_table(spark, d, "events").count()

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    def collect(df):
        df.collect()

    def stage_backfill_write():
        out = ST.scratch(spark, "bench-writeback")
        # embeddings are checkpointed inside (side-effect boundary), then written back
        RG.WB.write_snapshot(backfill.backfill_write_back(RG.user(spark, d)), out)

    def stage_stream():
        out, ck = ST.scratch(spark, "bench-stream"), ST.scratch(spark, "bench-stream-ck")
        path = ST.land_feed(derive.change_feed(read_table(spark, d, "events")),
                            ST.scratch(spark, "bench-landing"))
        ST.stream_vectorize(spark, ST.read_feed(spark, path, 2), derive.routing_config(spark),
                            out, ck, derive.DIMENSION, derive.CURRENT_MODEL).awaitTermination()

    recall_box = {}

    def stage_knn_ivf():
        corpus, qs = read_table(spark, d, "embeddings"), RG.knn_queries(spark, d)
        approx = KN.knn_ivf(spark, corpus, qs, 10)
        exact = KN.knn_exact(spark, corpus, qs, 10)
        rec = KN.recall_at_k(approx, exact).agg(F.avg("recall")).first()[0]
        recall_box["recall_at_10"] = round(float(rec or 0.0), 4)

    stages = {
        "clean_basic": (lambda: noop(docs.select("doc_id", C.basic_clean(F.col("text")))), n_docs),
        "clean_markdown": (lambda: noop(docs.select("doc_id", C.markdown_clean(F.col("text")))),
                           n_docs),
        "clean_html": (lambda: noop(pages.select("page_id", C.html_clean(F.col("html")))), n_pages),
        "embed_native": (lambda: noop(docs.select("doc_id", mock_embedding(
            C.basic_clean(F.col("text")), derive.DIMENSION).alias("v"))), n_docs),
        "embed_udf": (lambda: noop(EM.embed_column(
            docs.select("doc_id", C.basic_clean(F.col("text")).alias("c")), "c", "v", "mock",
            dimension=derive.DIMENSION, batch_size=256)), n_docs),
        "flagship_completion_after_backfill": (lambda: collect(
            backfill.completion_after_backfill(docs, read_table(spark, d, "embeddings"),
                                               embedder="udf")), n_docs),
        "flagship_native_embedding": (lambda: collect(
            backfill.completion_after_backfill(docs, read_table(spark, d, "embeddings"),
                                               embedder="native")), n_docs),
        "backfill_write_back": (stage_backfill_write, n_docs),
        "null_vector_counts": (lambda: collect(RG.QUERIES["null_vector_counts"](spark, d)), n_docs),
        "system_health": (lambda: collect(RG.QUERIES["system_health"](spark, d)), n_events),
        "system_health_full": (lambda: collect(RG.QUERIES["system_health_full"](spark, d)),
                               n_events),
        "completion_summary": (lambda: collect(RG.QUERIES["completion_summary"](spark, d)),
                               n_events),
        "snapshot_diff": (lambda: noop(RG.QUERIES["snapshot_diff"](spark, d)), n_docs),
        "route_events": (lambda: noop(RG.QUERIES["route_events"](spark, d)), n_events),
        "debounce_events": (lambda: noop(RG.QUERIES["debounce_events"](spark, d)), n_events),
        "knn_exact": (lambda: collect(RG.QUERIES["knn_exact"](spark, d)), None),
        "knn_ivf": (stage_knn_ivf, None),
        "stream_vectorize": (stage_stream, n_events),
    }
    # pass 1 warms the JVM (JIT) and Python workers for every stage; pass 2 is timed
    for fn, _ in stages.values():
        fn()
    times, rates = {}, {}
    for name, (fn, n) in stages.items():
        t0 = time.perf_counter()
        fn()
        dt = time.perf_counter() - t0
        times[name] = round(dt, 3)
        if n:
            rates[name] = round(n / dt, 1)
    out = {"metric": "total_warm_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf_of(SF_DIR), "rows_per_s": rates,
           "rows_per_s_per_core": {k: round(v / int(CPUS), 1) for k, v in rates.items()},
           "docs_per_s_full_batch_path": rates.get("backfill_write_back"),
           **recall_box}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
