"""Query registry: name -> callable(spark, sf_dir) -> DataFrame.

Each entry wires the given tables (or data Spark derives from them) into a
library operator.  ``oracle.py`` holds the independent DuckDB SQL for the
same names.
"""
from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce as _reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import DataFrame as _DF
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import errors as ER
from ..functions import vectors as V
from ..functions.vectors import CONFIG_DEFAULT_DIMENSIONS
from ..operators import catalog as K
from ..operators import detect, digest_tree as DT, routing as R
from ..operators import embed as EM
from ..operators import ivf as IVF
from ..operators import knn as KN
from ..operators import monitor as M
from ..operators import tasks as TK
from ..operators import writeback as WB
from ..sources import feed as FD
from ..sources import outbox as OB
from ..sources.tables import TABLES, read_table, scan_multi_target, scan_text_table
from ..streaming import jobs as ST
from ..streaming import retries as RT
from . import backfill, derive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


@register("completion_after_backfill")
def q_completion_after_backfill(spark, d):
    return backfill.completion_after_backfill(T(spark, d, "documents"), T(spark, d, "embeddings"),
                                              embedder="udf")


@register("completion_after_backfill_native")
def q_completion_after_backfill_native(spark, d):
    return backfill.completion_after_backfill(T(spark, d, "documents"), T(spark, d, "embeddings"),
                                              embedder="native")


# ---------------------------------------------------------------------------
# shared wiring
# ---------------------------------------------------------------------------


def user(spark, d):
    return derive.user_table(T(spark, d, "documents"), T(spark, d, "embeddings"))


def text_rows(spark, d):
    return derive.text_rows(*(T(spark, d, n) for n in
                              ("documents", "pages", "conversations", "benchmark", "part")))


def feed(spark, d):
    return derive.change_feed(T(spark, d, "events"))


def parsed_feed(spark, d):
    return FD.with_row_fields(FD.parse_feed(feed(spark, d)))


def routed_texts(spark, d):
    """Long-form texts joined with their (first) routing config."""
    rows = text_rows(spark, d).withColumn("database", F.lit(derive.DATABASE)) \
                              .withColumn("schema", F.lit(derive.SCHEMA))
    return R.route_events(rows, derive.routing_config(spark))


# --- S1 / S2 ----------------------------------------------------------------
@register("scan_text_table")
def q_scan_text_table(spark, d):
    return scan_text_table(T(spark, d, "documents"), "doc_id", "text")


@register("scan_multi_target")
def q_scan_multi_target(spark, d):
    return scan_multi_target(T(spark, d, "conversations"), ["conv_id", "turn"], ["role", "text"])


# --- F1–F8 ------------------------------------------------------------------
@register("clean_basic")
def q_clean_basic(spark, d):
    return T(spark, d, "documents").select("doc_id", C.basic_clean(F.col("text")).alias("cleaned"))


@register("clean_markdown")
def q_clean_markdown(spark, d):
    return T(spark, d, "documents").select("doc_id",
                                           C.markdown_clean(F.col("text")).alias("cleaned"))


@register("clean_html")
def q_clean_html(spark, d):
    return T(spark, d, "pages").select("page_id", C.html_clean(F.col("html")).alias("cleaned"))


@register("clean_html_parser")
def q_clean_html_parser(spark, d):
    return T(spark, d, "pages").select("page_id",
                                       C.html_clean_parser(F.col("html")).alias("cleaned"))


CLEAN_STEPS = ["html_extraction", "unicode_normalize", "markdown_conversion",
               "whitespace_cleanup"]


@register("clean_steps")
def q_clean_steps(spark, d):
    fns, labels, skipped = C.resolve_steps(CLEAN_STEPS)
    return T(spark, d, "pages").select(
        "page_id", C.pipeline(CLEAN_STEPS)(F.col("html")).alias("cleaned"),
        F.lit(C.pipeline_config_name("web_cleanup", CLEAN_STEPS)).alias("config_name"),
        F.lit(",".join(skipped)).alias("skipped_steps"))


@register("clean_presets")
def q_clean_presets(spark, d):
    docs = T(spark, d, "documents")
    cols = [C.pipeline(steps)(F.col("text")).alias(name) for name, steps in C.PRESETS.items()]
    return docs.select("doc_id", *cols).unpivot(["doc_id"], list(C.PRESETS), "preset", "cleaned")


@register("clean_routed")
def q_clean_routed(spark, d):
    r = routed_texts(spark, d)
    return r.select("table", "row_id",
                    R.clean_by_config(F.col("text"), F.col("cleaning_enabled"),
                                      F.col("cleaning_config")).alias("cleaned"))


@register("cleaned_with_provenance")
def q_cleaned_with_provenance(spark, d):
    steps = C.PRESETS["basic_text"]
    return T(spark, d, "documents").select(
        "doc_id", C.pipeline(steps)(F.col("text")).alias("text_cleaned"),
        F.lit(C.pipeline_config_name("basic_text", steps)).alias("text_cleaning_config"),
        F.lit(derive.AS_OF).cast("timestamp_ntz").alias("text_cleaned_at"))


@register("clean_extra")
def q_clean_extra(spark, d):
    t = F.col("text")
    return T(spark, d, "documents").select(
        "doc_id", C.lowercase(t).alias("lowered"), C.remove_punctuation(t).alias("no_punct"),
        C.limit_newlines(t).alias("newlines_limited"),
        C.normalize_whitespace(t).alias("ws_normalized"))


# --- J2 / P1–P9 / W3 / W4 / S3 / S8 / J1 / J3 ----------------------------------
@register("snapshot_diff")
def q_snapshot_diff(spark, d):
    old = derive.old_snapshot(T(spark, d, "documents"), T(spark, d, "benchmark"))
    return detect.snapshot_diff_narrow(old, T(spark, d, "documents"), "doc_id", "text")


@register("snapshot_diff_texts")
def q_snapshot_diff_texts(spark, d):
    old = derive.old_snapshot(T(spark, d, "documents"), T(spark, d, "benchmark"))
    diff = detect.snapshot_diff(old, T(spark, d, "documents"), "doc_id", "text")
    return diff.select("doc_id", "operation", F.length("old_text").alias("old_len"),
                       F.length("new_text").alias("new_len"))


@register("snapshot_diff_tree")
def q_snapshot_diff_tree(spark, d):
    docs = T(spark, d, "documents")
    old = derive.old_snapshot(docs, T(spark, d, "benchmark"))
    old, new = (DT.write_snapshot(s, "doc_id", "text", ST.scratch(spark, "snapshot-tree"), depth=3)
                for s in (old, docs))
    return DT.snapshot_changes(old, new, "doc_id", unchanged=True).drop("old_text", "new_text")


@register("feed_parse")
def q_feed_parse(spark, d):
    return parsed_feed(spark, d).select("event_id", "database", "schema", "table", "operation",
                                        "row_id", "new_text", "old_text", "config_key")


@register("feed_outbox")
def q_feed_outbox(spark, d):
    """S3 from an outbox table: a stream over its commit ids, stopped, the table grown, and
    started again from its checkpoint."""
    table, out, ck = (ST.scratch(spark, f"outbox-{x}") for x in ("table", "out", "ck"))
    events = feed(spark, d)
    middle = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    last = 0
    for part in (F.col("ts") <= F.lit(middle), F.col("ts") > F.lit(middle)):
        last = OB.append_outbox(events.filter(part), table, last)
        stream = ST.parsed(OB.read_feed_outbox(spark, path=table, rows_per_partition=5_000))
        (stream.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(availableNow=True).start()
         .awaitTermination())
    return spark.read.parquet(out).select(
        "event_id", "database", "schema", "table", "operation", "row_id", "new_text", "old_text",
        "config_key")


@register("feed_valid")
def q_feed_valid(spark, d):
    v = FD.with_validation(feed(spark, d))
    return v.select("event_id", F.col("reject_reason").isNull().alias("is_valid"),
                    F.array_join("missing_fields", ",").alias("missing_fields"))


@register("feed_rejects")
def q_feed_rejects(spark, d):
    return FD.feed_rejects(feed(spark, d)).select("event_id", "reject_reason")


@register("route_events")
def q_route_events(spark, d):
    r = R.route_events(parsed_feed(spark, d), derive.routing_config(spark))
    return r.select("event_id", "database", "table", "config_name", "config_order",
                    "text_column", "vector_column")


@register("unrouted_events")
def q_unrouted_events(spark, d):
    return R.unrouted_events(parsed_feed(spark, d), derive.routing_config(spark)) \
            .select("event_id", "database", "table")


@register("needs_vectorization")
def q_needs_vectorization(spark, d):
    r = FD.with_config_fields(R.route_events(parsed_feed(spark, d), derive.routing_config(spark)))
    flag = detect.needs_vectorization(F.col("operation"), F.col("new_vector"),
                                      F.col("old_text"), F.col("new_text"))
    return r.select("event_id", "table", "operation", "row_id",
                    flag.alias("needs_vectorization"))


@register("debounce_events")
def q_debounce_events(spark, d):
    p = parsed_feed(spark, d)
    return detect.debounce(p, ["table", "row_id"], "ts", 3600.0) \
                 .select("event_id", "table", "row_id", "ts")


@register("latest_event")
def q_latest_event(spark, d):
    p = parsed_feed(spark, d)
    return detect.latest_per_key(p, ["table", "row_id"], "ts", ["event_id"]) \
                 .select("event_id", "table", "row_id", "operation")


@register("backfill_set")
def q_backfill_set(spark, d):
    return detect.backfill_set(user(spark, d), "text_vector").select("doc_id", "priority")


@register("skip_blank")
def q_skip_blank(spark, d):
    r = routed_texts(spark, d)
    cleaned = R.clean_by_config(F.col("text"), F.col("cleaning_enabled"), F.col("cleaning_config"))
    return r.select("table", "row_id", detect.blank_status(F.col("text"), cleaned).alias("status"))


CONDITIONS = ["quality = 1", "toxic = 0", "lang IN ('en', 'de')"]


@register("conditional_backfill")
def q_conditional_backfill(spark, d):
    u = user(spark, d).join(T(spark, d, "labels"), "doc_id", "left")
    todo = detect.apply_conditions(detect.backfill_set(u, "text_vector"), CONDITIONS)
    return todo.select("doc_id", "lang", "quality", "toxic")


@register("outdated_model")
def q_outdated_model(spark, d):
    return detect.outdated_model(user(spark, d), "text_vector", "text_embedding_model",
                                 derive.CURRENT_MODEL).select("doc_id", "text_embedding_model")


@register("recent_log")
def q_recent_log(spark, d):
    """P7 at three look-backs from one scan: the widest window is the pushed
    filter, the narrower ones are conditional counts."""
    lg = detect.look_back(log(spark, d), "created_at", derive.AS_OF, "7 DAYS")
    a = F.lit(derive.AS_OF).cast("timestamp_ntz")
    c = lg.groupBy("status").agg(
        F.count_if(F.col("created_at") > a - F.expr("INTERVAL 1 HOURS")).alias("1 HOURS"),
        F.count_if(F.col("created_at") > a - F.expr("INTERVAL 24 HOURS")).alias("24 HOURS"),
        F.count(F.lit(1)).alias("7 DAYS"))
    return c.unpivot(["status"], ["1 HOURS", "24 HOURS", "7 DAYS"], "look_back", "n") \
            .filter(F.col("n") > 0)


@register("input_quality")
def q_input_quality(spark, d):
    r = text_rows(spark, d)
    return r.groupBy("table", detect.input_quality(F.col("text")).alias("quality")) \
            .agg(F.count(F.lit(1)).alias("n"))


@register("desired_columns")
def q_desired_columns(spark, d):
    """P11 with the number of rows each companion column will be filled for."""
    counts = text_rows(spark, d).groupBy("table").agg(F.count(F.lit(1)).alias("rows_to_fill"))
    return R.desired_columns(derive.routing_config(spark)) \
            .select("config_order", "table", "text_column", "column_name", "role") \
            .join(counts, "table", "left")


# ---------------------------------------------------------------------------
# batch 3: embedding, write-back, monitoring, tasks
# ---------------------------------------------------------------------------


def checksum(v):
    return F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), 4)


def log(spark, d):
    return derive.vectorization_log(T(spark, d, "events"))


def tasks(spark, d):
    return derive.task_table(T(spark, d, "events"))


def history(spark, d):
    return derive.status_history(T(spark, d, "events"))


def target_null_counts(spark, d):
    """A1 per configured target: documents from the stored vectors, the other
    text tables have no vector column yet (every row counts as NULL)."""
    docs = M.null_vector_counts(user(spark, d), "text_vector") \
        .withColumn("table_name", F.lit("documents"))
    others = text_rows(spark, d).filter(F.col("table") != "documents") \
        .groupBy(F.col("table").alias("table_name")) \
        .agg(F.count(F.lit(1)).alias("null_vectors"), F.count(F.lit(1)).alias("total_rows"))
    return docs.unionByName(others).select(
        F.lit(derive.DATABASE).alias("database_name"), F.lit(derive.SCHEMA).alias("schema_name"),
        "table_name", F.lit("text_vector").alias("vector_column"), "null_vectors", "total_rows")


@register("null_vector_counts")
def q_null_vector_counts(spark, d):
    return M.null_vector_counts(user(spark, d), "text_vector", ["lang"])


@register("completion")
def q_completion(spark, d):
    c = M.null_vector_counts(user(spark, d), "text_vector", ["lang"])
    return c.select("lang", M.completion_pct(F.col("null_vectors"), F.col("total_rows"))
                    .alias("completion_percentage"))


@register("check_null_vectors")
def q_check_null_vectors(spark, d):
    c = target_null_counts(spark, d)
    return c.select("table_name", "vector_column", "null_vectors", "total_rows",
                    M.completion_pct(F.col("null_vectors"), F.col("total_rows"))
                    .alias("completion_percentage"),
                    F.lit("success").alias("status"),
                    (F.col("null_vectors") > 0).alias("backfill_requested"))


@register("backfill_requests")
def q_backfill_requests(spark, d):
    return TK.backfill_requests(target_null_counts(spark, d)) \
             .select("table_name", "vector_column", "null_count", "priority")


CHECK_TIME = "2024-01-30 23:59:59"


@register("null_status_daily")
def q_null_status_daily(spark, d):
    checks = target_null_counts(spark, d).select(
        F.lit(CHECK_TIME).cast("timestamp_ntz").alias("checked_at"), "database_name", "schema_name",
        "table_name", "vector_column", F.lit("default").alias("config_key"),
        F.col("null_vectors").cast("long").alias("null_vectors"),
        F.col("total_rows").cast("long").alias("total_rows"),
        F.lit(None).cast("timestamp_ntz").alias("last_vectorized_at"))
    return WB.upsert_daily_status(history(spark, d), checks).select(
        "table_name", F.to_date("checked_at").alias("day"), "checked_at", "null_vectors",
        "total_rows", "completion_percentage")


@register("system_health")
def q_system_health(spark, d):
    return M.system_health(log(spark, d), derive.AS_OF) \
            .withColumn("avg_processing_time_ms", F.round("avg_processing_time_ms", 6))


@register("system_health_full")
def q_system_health_full(spark, d):
    ev = T(spark, d, "events")
    h = M.system_health_full(history(spark, d), log(spark, d), derive.drift_log(ev),
                             derive.collision_log(ev), derive.AS_OF)
    return h.withColumn("avg_completion_percentage", F.round("avg_completion_percentage", 6)) \
            .withColumn("avg_processing_time_ms", F.round("avg_processing_time_ms", 6)) \
            .withColumn("p95_processing_time_ms", F.round("p95_processing_time_ms", 6))


def cleaned(spark, d):
    """doc_id, source and cleaned text of the documents."""
    return T(spark, d, "documents").select("doc_id", "source",
                                           C.basic_clean(F.col("text")).alias("clean"))


@register("embed_cached")
def q_embed_cached(spark, d):
    """Documents of all but one source embedded through a new cache, then all documents: their
    texts of before are hits, and every other distinct text is sent once."""
    from ..operators import vector_cache as VC
    docs = cleaned(spark, d)
    cache = VC.VectorCache.create(spark, ST.scratch(spark, "vector-cache"), 16, 1 << 16)
    model = derive.CURRENT_MODEL
    VC.embed_cached(docs.filter("source <> 'src0'"), "doc_id", "clean", cache,
                    ST.scratch(spark, "cached-run"), model, derive.DIMENSION)
    got = VC.embed_cached(docs, "doc_id", "clean", cache, ST.scratch(spark, "cached-run"), model,
                          derive.DIMENSION)
    return got.select("doc_id", "outcome", "sent", F.size("vector").alias("dim"),
                      checksum(F.col("vector")).alias("checksum"))


@register("batch_plan_packed")
def q_batch_plan_packed(spark, d):
    """The texts of every target packed into requests of at most 32 texts and 4,000 tokens:
    totals per target, and whether the limits and 1.25 times the lower bound hold."""
    from ..operators import packing as PK
    rows = routed_texts(spark, d).select("table", "row_id", "text")
    packed = PK.pack_requests(rows, "row_id", "text", 32, 4000, ["table"])
    t = PK.request_totals(packed, 32, 4000, ["table"])
    return t.select("table", "texts", "tokens", (F.col("most_texts") <= 32).alias("texts_fit"),
                    F.coalesce(F.col("most_tokens") <= 4000, F.lit(True)).alias("tokens_fit"),
                    (F.col("requests") <= 1.25 * F.col("lower_bound") + 1).alias("near_bound"))


@register("embed_packed")
def q_embed_packed(spark, d):
    """All documents embedded by packed requests, one call for each."""
    from ..operators import packing as PK
    packed = PK.pack_requests(cleaned(spark, d), "doc_id", "clean", 32, 4000)
    got = PK.embed_requests(packed.select("doc_id", "clean", "request"), "clean",
                            dimension=derive.DIMENSION)
    return got.select("doc_id", F.size("vector").alias("dim"),
                      checksum(F.col("vector")).alias("checksum"))


@register("embed_in_waves")
def q_embed_in_waves(spark, d):
    """All documents embedded in waves against a provider that serves four tasks at a time."""
    from ..operators import waves as WV
    got, _ = WV.embed_in_waves(cleaned(spark, d), "doc_id", "clean", ST.scratch(spark, "waves"),
                               "throttled", start=6, rows_per_task=200, limit=4,
                               dimension=derive.DIMENSION)
    return got.select("doc_id", F.size("vector").alias("dim"),
                      checksum(F.col("vector")).alias("checksum"))


@register("health_sketches")
def q_health_sketches(spark, d):
    """Health per table from stored daily sketches, over the last seven days of the log and
    over all: exact counts, and whether the sketched figures are within their stated errors of
    the exact ones."""
    from ..operators import health as H
    rows, path = log(spark, d), ST.scratch(spark, "health-sketches")
    H.store_sketches(rows, path)
    last = rows.agg(F.max(F.to_date("created_at"))).first()[0]
    out = None
    e = M.kll_rank_error()
    for label, first in (("week", last - timedelta(days=6)), ("all", date(1970, 1, 1))):
        window = rows.filter(F.to_date("created_at").between(F.lit(first), F.lit(last)))
        ok = F.when(F.col("status") == "success", F.col("processing_time").cast("double"))
        got = H.health_between(spark, path, str(first), str(last))
        ranks = (window.withColumn("ms", ok).join(got.select(*M.TABLE_KEY, "p_ms"), M.TABLE_KEY)
                 .groupBy(*M.TABLE_KEY).agg(
                     (F.count_if(F.col("ms") < F.col("p_ms")) / F.count("ms")).alias("low"),
                     (F.count_if(F.col("ms") <= F.col("p_ms")) / F.count("ms")).alias("high"),
                     F.count_distinct("row_id").alias("n_rows")))
        both = got.join(ranks, M.TABLE_KEY).select(
            F.lit(label).alias("look_back"), "table_name", "total", "successful", "failed",
            F.round("avg_ms", 6).alias("avg_ms"), "last_vectorization", "distinct_models",
            (F.col("p_ms").isNull() | ((F.col("low") <= 0.95 + e) & (F.col("high") >= 0.95 - e)))
            .alias("p95_within_bounds"),
            (F.abs(F.col("distinct_rows") - F.col("n_rows")) <= 0.07 * F.col("n_rows") + 1)
            .alias("rows_within_bounds"))
        out = both if out is None else out.unionByName(both)
    return out


@register("completeness_incremental")
def q_completeness_incremental(spark, d):
    """A1/A2 of the users' table from totals of its previous snapshot and the changes since,
    in two batches of which the first is replayed, with the store folded in between."""
    from ..operators import incremental as IN
    new = user(spark, d)
    old = derive.old_user_table(T(spark, d, "documents"), T(spark, d, "benchmark"),
                                T(spark, d, "embeddings"))
    missing = F.col("text_vector").isNull()
    store = IN.Totals(spark, ST.scratch(spark, "completeness"), new.schema["lang"].dataType)
    store.start(M.null_vector_counts(old, "text_vector", ["lang"]).withColumnRenamed(
        "lang", "group"))
    changes = IN.row_changes(old, new, "doc_id", "lang", missing)
    first = F.coalesce(F.col("new_group"), F.lit("")) < "f"
    store.apply(0, changes.filter(first))
    store.apply(0, changes.filter(first))
    store = store.fold(ST.scratch(spark, "completeness"))
    store.apply(0, changes.filter(first))
    store.apply(1, changes.filter(~first))
    return store.current().select(F.col("group").alias("lang"), "null_vectors", "total_rows",
                                  "completion_percentage")


@register("status_summary")
def q_status_summary(spark, d):
    return M.status_summary(log(spark, d), ["table_name"])


@register("failure_reasons")
def q_failure_reasons(spark, d):
    return M.failure_reasons(log(spark, d), ["table_name"])


@register("throughput")
def q_throughput(spark, d):
    return M.throughput(log(spark, d), F.to_date("created_at"))


@register("queue_depth")
def q_queue_depth(spark, d):
    return M.queue_depth(tasks(spark, d))


@register("latest_status")
def q_latest_status(spark, d):
    return M.latest_status(history(spark, d)).select("table_name", "vector_column", "checked_at",
                                                     "null_vectors", "total_rows")


@register("completion_summary")
def q_completion_summary(spark, d):
    return M.completion_summary(history(spark, d), derive.AS_OF)


@register("recent_history")
def q_recent_history(spark, d):
    cl = derive.collision_log(T(spark, d, "events"))
    return M.recent_history(cl, ["table_name"], "occurred_at", 5, ["desired_column_name"]) \
            .select("table_name", "rn", "occurred_at", "desired_column_name", "collision_severity")


@register("next_tasks")
def q_next_tasks(spark, d):
    return TK.next_tasks(tasks(spark, d), derive.AS_OF, 50) \
             .select("id", "priority", "scheduled_at", "table_name")


def FAILED_TASKS():
    return F.col("status") == "failed"


@register("retry_schedule")
def q_retry_schedule(spark, d):
    f = tasks(spark, d).filter(FAILED_TASKS())
    return TK.schedule_retries(f, 5.0, 3).select("id", "retry_count", "decision",
                                                 "next_retry_count", "delay_s", "retry_at")


@register("dead_letter")
def q_dead_letter(spark, d):
    f = tasks(spark, d).filter(FAILED_TASKS())
    _, dead = WB.split_dead_letter(f, F.col("retry_count"), F.col("max_retries"))
    return dead.select("id", "task_id", "table_name", "row_id", "retry_count")


@register("attempt_history")
def q_attempt_history(spark, d):
    h = TK.attempt_history(log(spark, d), ["table_name", "row_id"], "created_at", "log_id",
                           F.col("status") == "failed")
    return h.select("log_id", "table_name", "row_id", "attempt_no", "failures_before")


@register("embed_deterministic")
def q_embed_deterministic(spark, d):
    v = V.mock_embedding(F.col("text"), derive.DIMENSION)
    return T(spark, d, "documents").select("doc_id", v.alias("v")) \
        .select("doc_id", V.vsize("v").alias("dim"), checksum(F.col("v")).alias("checksum"))


@register("embed_udf")
def q_embed_udf(spark, d):
    docs = T(spark, d, "documents").select("doc_id", C.basic_clean(F.col("text")).alias("clean"))
    e = EM.embed_column(docs, "clean", "v", "mock", dimension=derive.DIMENSION, batch_size=64)
    return e.select("doc_id", V.vsize("v").alias("dim"), checksum(F.col("v")).alias("checksum"))


@register("embed_with_failures")
def q_embed_with_failures(spark, d):
    """A provider that refuses some texts for good and some for now: vectors, dead letters
    and retries of the whole table."""
    docs = T(spark, d, "documents").select("doc_id", C.basic_clean(F.col("text")).alias("clean"))
    e = EM.embed_outcomes(docs, "clean", "faulty", dimension=derive.DIMENSION, batch_size=32)
    return e.select("doc_id", "outcome", "message", V.vsize("vector").alias("dim"),
                    checksum(F.col("vector")).alias("checksum"))


@register("write_back")
def q_write_back(spark, d):
    out = backfill.backfill_write_back(user(spark, d))
    return out.select("doc_id", "text_embedding_model", "text_vector_created_at",
                      V.vsize("text_vector").alias("dim"),
                      checksum(F.col("text_vector")).alias("checksum"))


@register("vectorization_log_rows")
def q_vectorization_log_rows(spark, d):
    from .backfill import backfill_vectors
    # the rows that backfill_status would call 'present' are left out before the embedding: a
    # filter on the status is pushed below it and would clean and embed every row several times
    done = backfill_vectors(user(spark, d).filter(F.col("text_vector").isNull()))
    st = F.when(F.col("backfill_status") == "created", "success") \
          .when(F.col("backfill_status") == "skipped", "skipped").otherwise("failed")
    rows = WB.log_rows(done.withColumn("st", st), derive.DATABASE, derive.SCHEMA, "documents",
                       "text", "text_vector", derive.CURRENT_MODEL, derive.AS_OF, "doc_id", "st",
                       "text", "text_vector")
    return rows.select("row_id", "status", "text_length", "vector_dimension", "embedding_model")


@register("vectorization_log_append")
def q_vectorization_log_append(spark, d):
    """The log in two batches, the second replayed, into the date-partitioned table."""
    rows, path = log(spark, d), ST.scratch(spark, "vectorization-log")
    early = F.to_date("created_at") < F.lit(derive.AS_OF).cast("date")
    for batch, part in ((0, early), (1, ~early), (1, ~early)):
        WB.append_log(rows.filter(part), path, batch)
    return WB.read_log(spark, path).groupBy("log_date", "table_name", "status").agg(
        F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last"))


@register("embed_http")
def q_embed_http(spark, d):
    """UD2: the hosted provider's client over all documents, a transport in place of a server."""
    e = EM.embed_column(cleaned(spark, d), "clean", "v", "openai", dimension=derive.DIMENSION,
                        model=derive.CURRENT_MODEL, transport=derive.provider_stand_in,
                        send_dimensions=True, batch_size=64, api_key="none")
    return e.select("doc_id", F.size("v").alias("dim"), checksum(F.col("v")).alias("checksum"))


@register("stream_retries_until_done")
def q_stream_retries_until_done(spark, d):
    """ST4: the feed vectorized by a provider that refuses some texts for now and some for good,
    then retries until none is due: every row's last outcome."""
    bad = dict(provider="faulty", modulus=10, dead=0, busy=6)
    out = ST.scratch(spark, "retries-out")
    path = ST.land_feed(feed(spark, d), ST.scratch(spark, "retries-landing"))
    ST.stream_vectorize(spark, ST.read_feed(spark, path), derive.routing_config(spark), out,
                        ST.scratch(spark, "retries-ck"), derive.DIMENSION, derive.CURRENT_MODEL,
                        **bad).awaitTermination()
    while ST.run_retries(spark, out, "2199-01-01 00:00:00", derive.DIMENSION,
                         derive.CURRENT_MODEL, **bad):
        pass
    return ST._latest_attempts(spark, out).select("table", "row_id", "event_id", "outcome",
                                                  "retry_count")


@register("vector_validity")
def q_vector_validity(spark, d):
    u = user(spark, d)
    return u.groupBy(V.vector_status(F.col("text_vector"), derive.DIMENSION).alias("vector_status")) \
            .agg(F.count(F.lit(1)).alias("n"))


def response_bodies(spark, d):
    """Embedding responses rendered per language in one of the four shapes."""
    docs = T(spark, d, "documents").select(
        "doc_id", "lang", V.mock_embedding(F.col("text"), 4).alias("v"))
    vj = F.to_json(F.col("v"))
    body = (F.when(F.col("lang") == "en",
                   F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"),
                                                       F.col("v").alias("embedding"))).alias("data"))))
             .when(F.col("lang") == "fr", F.to_json(F.struct(F.array("v").alias("embeddings"))))
             .when(F.col("lang") == "de", F.concat(F.lit("["), vj, F.lit("]")))
             .otherwise(F.to_json(F.struct(F.col("v").alias("vector")))))
    return docs.select("doc_id", "lang", body.alias("body"))


@register("parse_responses")
def q_parse_responses(spark, d):
    r = response_bodies(spark, d).withColumn("vs", ER.parse_embedding_response(F.col("body")))
    return r.select("doc_id", F.posexplode("vs").alias("pos", "v")) \
            .select("doc_id", "pos", V.vsize("v").alias("dim"), checksum(F.col("v")).alias("checksum"))


def error_bodies(spark, d):
    lg = log(spark, d).filter(F.col("status") == "failed")
    k = F.col("text_length")
    msg = F.concat(F.lit("failure "), k.cast("string"))
    body = (F.when(k < 15, F.to_json(F.struct(F.struct(msg.alias("message")).alias("error"))))
             .when(k < 30, F.to_json(F.struct(msg.alias("error"))))
             .when(k < 45, F.to_json(F.struct(msg.alias("message"))))
             .when(k < 60, F.to_json(F.struct(msg.alias("detail"))))
             .when(k < 75, F.to_json(F.struct(F.array(msg, F.lit("more")).alias("detail"))))
             .when(k < 90, F.to_json(F.struct(msg.alias("description"))))
             .otherwise(F.to_json(F.struct(k.alias("code")))))
    return lg.select("log_id", "text_length", body.alias("body"))


@register("parse_errors")
def q_parse_errors(spark, d):
    return error_bodies(spark, d).select("log_id", ER.parse_error_message(F.col("body"))
                                         .alias("message"))


def status_codes(spark, d):
    k = F.col("text_length")
    code = (F.when(k < 10, 429).when(k < 20, 401).when(k < 25, 403).when(k < 35, 422)
             .when(k < 60, 500).when(k < 80, 503).otherwise(0))
    ra = F.when((k < 10) & (k >= 5), k)
    return log(spark, d).filter(F.col("status") == "failed") \
        .select("log_id", code.alias("status_code"), ra.alias("retry_after"))


@register("classify_failures")
def q_classify_failures(spark, d):
    s = status_codes(spark, d)
    c = ER.classify_failure(F.col("status_code"), F.col("retry_after"))
    return s.select("log_id", "status_code", c["error_class"].alias("error_class"),
                    c["retryable"].alias("retryable"), c["wait_s"].alias("wait_s"))


# ---------------------------------------------------------------------------
# batch 4: catalog, collisions, naming, reconciliation
# ---------------------------------------------------------------------------


def catalog_tables(spark, d):
    """The given tables, with ``documents`` seen as the user table (its
    stored vectors and companion columns joined in)."""
    out = {t: T(spark, d, t) for t in TABLES if t != "documents"}
    out["documents"] = user(spark, d)
    return out


def catalog(spark, d):
    return K.column_catalog(spark, catalog_tables(spark, d), derive.DATABASE, derive.SCHEMA)


def registry_rows(spark, d, cat=None):
    """column_registry derived from the catalog: every vector column and its
    ``{text}_embedding_model`` sibling are registered."""
    c = catalog(spark, d) if cat is None else cat
    vec = c.filter("is_vector").select("database_name", "schema_name", "table_name",
                                       F.col("column_name").alias("vcol"), "dimension")
    model = c.select("table_name", F.col("column_name").alias("mcol"))
    base = F.regexp_replace("vcol", "_vector$", "")
    vrows = vec.select("database_name", "schema_name", "table_name",
                       F.col("vcol").alias("original_column_name"),
                       F.col("vcol").alias("actual_column_name"),
                       F.lit("vector").alias("column_type"), "dimension")
    mrows = vec.join(model, (vec.table_name == model.table_name)
                     & (model.mcol == F.concat(base, F.lit("_embedding_model")))) \
        .select(vec.database_name, vec.schema_name, vec.table_name,
                F.col("mcol").alias("original_column_name"),
                F.col("mcol").alias("actual_column_name"),
                F.lit("model").alias("column_type"), F.lit(None).cast("int").alias("dimension"))
    return vrows.unionByName(mrows).select(
        "*", F.lit(derive.CURRENT_MODEL).alias("model_name"),
        F.lit(derive.VECTORS_CREATED_AT).cast("timestamp_ntz").alias("created_at"),
        F.lit("default").alias("config_key"))


def desired(spark, d):
    return R.desired_columns(derive.routing_config(spark)).select(
        F.col("database").alias("database_name"), F.col("schema").alias("schema_name"),
        F.col("table").alias("table_name"), "text_column", "column_name", "role")


def collisions(spark, d, cat=None):
    cat = catalog(spark, d) if cat is None else cat     # a query builds it once
    hist = K.history_keys(registry_rows(spark, d, cat),
                          derive.collision_log(T(spark, d, "events")))
    return K.classify_collisions(desired(spark, d), cat, hist)


ROLE_TYPES = {"vector": "vector", "model": "text", "timestamp": "timestamp",
              "cleaned": "text", "cleaned_config": "text", "cleaned_timestamp": "timestamp"}


def role_type(role):
    out = None
    for r, t in ROLE_TYPES.items():
        out = F.when(role == r, t) if out is None else out.when(role == r, t)
    return out


@register("column_catalog")
def q_column_catalog(spark, d):
    return catalog(spark, d).select("table_name", "column_name", "data_type",
                                    "ordinal_position", "is_vector", "dimension", "row_count")


@register("vector_tables")
def q_vector_tables(spark, d):
    return K.vector_tables(catalog(spark, d)).select(
        "table_name", F.array_join("vector_columns", ",").alias("vector_columns"))


def feed_tables(spark, d):
    return parsed_feed(spark, d).select(F.col("table").alias("table_name")).distinct()


@register("table_status")
def q_table_status(spark, d):
    configured = derive.routing_config(spark).select(F.col("table").alias("table_name")) \
        .unionByName(feed_tables(spark, d))
    return K.table_status(catalog(spark, d), configured)


@register("missing_components")
def q_missing_components(spark, d):
    existing = catalog(spark, d).select("table_name").distinct()
    return K.missing_components(feed_tables(spark, d), existing)


@register("classify_collisions")
def q_classify_collisions(spark, d):
    return collisions(spark, d).select(
        "table_name", "column_name", "severity", "collision_type", "matched_pattern",
        "existing_column_type", F.array_join("alternative_names", ",").alias("alternatives"))


@register("alternative_names")
def q_alternative_names(spark, d):
    """F9 for every column of every table: alternatives to each existing name."""
    c = catalog(spark, d)
    ex = c.groupBy("table_name").agg(F.collect_set("column_name").alias("existing"))
    return c.select("table_name", "column_name").join(ex, "table_name").select(
        "table_name", "column_name",
        F.array_join(K.alternative_names(F.col("column_name"), F.col("existing")), ",")
         .alias("alternatives"),
        F.array_join(K.prefix_alternatives(F.col("column_name"), F.col("existing")), ",")
         .alias("prefix_alternatives"))


@register("resolve_columns")
def q_resolve_columns(spark, d):
    return K.resolve_columns(collisions(spark, d)).select(
        "table_name", "column_name", "severity", "resolved_column_name", "resolution_strategy",
        "blocked")


@register("collision_summary")
def q_collision_summary(spark, d):
    return K.collision_summary(collisions(spark, d)) \
        .withColumn("critical_columns", F.array_join("critical_columns", ","))


@register("collision_log_rows")
def q_collision_log_rows(spark, d):
    r = K.resolve_columns(collisions(spark, d))
    return K.collision_log_rows(r, derive.AS_OF, "default").select(
        "table_name", "desired_column_name", "collision_severity", "collision_type",
        "resolution_strategy", "resolved_column_name", "details")


@register("column_history")
def q_column_history(spark, d):
    hist = K.history_keys(registry_rows(spark, d), derive.collision_log(T(spark, d, "events")))
    return desired(spark, d).join(hist, ["schema_name", "table_name", "column_name"],
                                  "left_semi").select("table_name", "column_name", "role")


@register("column_mapping")
def q_column_mapping(spark, d):
    m = K.column_mapping(desired(spark, d), registry_rows(spark, d))
    return m.select("table_name", "text_column", "role", "column_name", "actual_column_name")


@register("reconcile_plan")
def q_reconcile_plan(spark, d):
    cat = catalog(spark, d)
    r = K.resolve_columns(collisions(spark, d, cat)).withColumn("column_type",
                                                                role_type(F.col("role")))
    return K.reconcile_plan(r, cat).select(
        "table_name", "column_name", "resolved_column_name", "ddl", "blocked", "large_table")


@register("schema_drift")
def q_schema_drift(spark, d):
    routing = derive.routing_config(spark)
    dims = F.create_map(*[x for k_, v in CONFIG_DEFAULT_DIMENSIONS.items()
                          for x in (F.lit(k_), F.lit(v))])
    exp = R.desired_columns(routing).select(
        F.col("schema").alias("schema_name"), F.col("table").alias("table_name"),
        "column_name", role_type(F.col("role")).alias("expected_type"),
        F.when(F.col("role") == "vector", F.coalesce(dims[F.col("embedding_config")], F.lit(768)))
         .alias("expected_dimension"))
    return K.schema_drift(exp, catalog(spark, d)).select(
        "table_name", "column_name", "drift_type", "expected_type", "actual_type",
        "expected_dimension", "actual_dimension")


@register("model_dimension_check")
def q_model_dimension_check(spark, d):
    c = catalog(spark, d).filter("is_vector")
    routing = derive.routing_config(spark)
    used = routing.join(c, (routing.table == c.table_name) & (routing.vector_column == c.column_name)) \
        .groupBy(F.col("embedding_config").alias("config_name")) \
        .agg(F.max("dimension").alias("observed_dimension"))
    chk = K.model_dimension_check(derive.embedding_configs(spark), K.known_dimensions(spark))
    return chk.join(used, "config_name", "left").select(
        "config_name", "model", "dimensions", "known_dimension", "observed_dimension", "status")


@register("add_companions")
def q_add_companions(spark, d):
    u = user(spark, d)
    want = {"text_vector": "array<float>", "text_embedding_model": "string",
            "text_vector_created_at": "timestamp_ntz", "text_cleaned": "string",
            "text_cleaned_config": "string", "text_cleaned_at": "timestamp_ntz"}
    add = [c for c in want if c not in u.columns]
    out = K.add_missing_columns(u, want)
    return out.select("doc_id", F.col("text_vector").isNotNull().alias("has_vector"),
                      "text_embedding_model", "text_cleaned", "text_cleaned_config",
                      F.lit(",".join(sorted(add))).alias("added_columns"))


@register("registry_upsert")
def q_registry_upsert(spark, d):
    cat = catalog(spark, d)
    old = registry_rows(spark, d, cat)
    r = K.resolve_columns(collisions(spark, d, cat)).filter(~F.col("blocked"))
    new = r.select("database_name", "schema_name", "table_name",
                   F.col("column_name").alias("original_column_name"),
                   F.col("resolved_column_name").alias("actual_column_name"),
                   K.role_family(F.col("role")).alias("column_type"),
                   F.lit(None).cast("int").alias("dimension"),
                   F.lit(derive.CURRENT_MODEL).alias("model_name"),
                   F.lit(derive.AS_OF).cast("timestamp_ntz").alias("created_at"),
                   F.lit("default").alias("config_key"))
    return WB.upsert_registry(old, new).select(
        "table_name", "original_column_name", "actual_column_name", "column_type", "dimension",
        "created_at")


@register("all_targets_completion")
def q_all_targets_completion(spark, d):
    per_table = [M.null_vector_counts(user(spark, d), "text_vector")
                 .withColumn("table_name", F.lit("documents"))]
    rows = text_rows(spark, d)
    for t in ("pages", "conversations", "benchmark", "part"):
        per_table.append(rows.filter(F.col("table") == t)
                         .withColumn("no_vector", F.lit(None).cast("array<float>"))
                         .transform(lambda df: M.null_vector_counts(df, "no_vector"))
                         .withColumn("table_name", F.lit(t)))
    allc = _reduce(_DF.unionByName, per_table)
    return allc.select("table_name", "null_vectors", "total_rows",
                       M.completion_pct(F.col("null_vectors"), F.col("total_rows"))
                       .alias("completion_percentage"))


# ---------------------------------------------------------------------------
# batch 5: vectors, k-NN, migration
# ---------------------------------------------------------------------------

KNN_K = 10


def knn_queries(spark, d):
    """Query vectors: the benchmark passages embedded with the test embedder."""
    b = T(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"),
                    V.mock_embedding(C.basic_clean(F.col("text")), derive.DIMENSION)
                    .alias("query_vector"))


def _knn(metric):
    def q(spark, d):
        r = KN.knn_exact(spark, T(spark, d, "embeddings"), knn_queries(spark, d), KNN_K, metric)
        return r.withColumn("score", F.round("score", 6))
    return q


register("knn_exact")(_knn("l2"))
register("knn_exact_cosine")(_knn("cosine"))
register("knn_exact_ip")(_knn("ip"))


@register("knn_ivf")
def q_knn_ivf(spark, d):
    corpus, qs = T(spark, d, "embeddings"), knn_queries(spark, d)
    approx = KN.knn_ivf(spark, corpus, qs, KNN_K)
    exact = KN.knn_exact(spark, corpus, qs, KNN_K)
    rec = KN.recall_at_k(approx, exact)
    return approx.join(rec, "query_id").withColumn("score", F.round("score", 6))


@register("knn_ivf_full_probe")
def q_knn_ivf_full_probe(spark, d):
    r = KN.knn_ivf(spark, T(spark, d, "embeddings"), knn_queries(spark, d), KNN_K, nlist=8,
                   nprobe=8)
    return r.withColumn("score", F.round("score", 6))


def _knn_filtered(metric):
    def q(spark, d):
        from ..operators import quantised as QN
        corpus = T(spark, d, "embeddings")
        codes = QN.write_codes(corpus, ST.scratch(spark, "codes"), metric)
        r, _ = QN.knn_filtered(codes, corpus, knn_queries(spark, d), KNN_K,
                               ST.scratch(spark, "filtered"), metric)
        return r.withColumn("score", F.round("score", 6))
    return q


register("knn_exact_filtered")(_knn_filtered("l2"))
register("knn_exact_filtered_cosine")(_knn_filtered("cosine"))
register("knn_exact_filtered_ip")(_knn_filtered("ip"))


def ivf_index(spark, d, metric="l2"):
    """The stored index of the embeddings, written anew."""
    path = IVF.build(T(spark, d, "embeddings"), ST.scratch(spark, "ivf-index"), metric)
    return IVF.Index(spark, path)


@register("knn_ivf_index")
def q_knn_ivf_index(spark, d):
    index, qs = ivf_index(spark, d), knn_queries(spark, d)
    approx = IVF.search(index, qs, KNN_K)
    rec = KN.recall_at_k(approx, IVF.search(index, qs, KNN_K, exact=True))
    return approx.join(rec, "query_id").withColumn("score", F.round("score", 6))


@register("knn_ivf_index_exact")
def q_knn_ivf_index_exact(spark, d):
    r = IVF.search(ivf_index(spark, d), knn_queries(spark, d), KNN_K, exact=True)
    return r.withColumn("score", F.round("score", 6))


@register("knn_ivf_index_cosine")
def q_knn_ivf_index_cosine(spark, d):
    r = IVF.search(ivf_index(spark, d, "cosine"), knn_queries(spark, d), KNN_K, exact=True)
    return r.withColumn("score", F.round("score", 6))


@register("vector_text_roundtrip")
def q_vector_text_roundtrip(spark, d):
    e = T(spark, d, "embeddings")
    back = V.text_to_vector(V.vector_to_text(F.col("embedding")))
    return e.select("vec_id", V.vsize(back).alias("dim"),
                    (back == F.col("embedding")).alias("roundtrip_equal"))


@register("truncate_vectors")
def q_truncate_vectors(spark, d):
    e = T(spark, d, "embeddings")
    return e.select("vec_id", checksum(V.truncate_vector(F.col("embedding"), 16)).alias("checksum"),
                    checksum(V.truncate_vector(F.col("embedding"), 16, True)).alias("checksum_unit"),
                    V.vsize(V.truncate_vector(F.col("embedding"), 16)).alias("dim"))


@register("dimension_migration")
def q_dimension_migration(spark, d):
    return KN.dimension_migration_plan(user(spark, d), "text_vector", "text_vector_32", 32,
                                       ["lang"])


@register("migration_progress")
def q_migration_progress(spark, d):
    u = user(spark, d)
    migrated = u.withColumn("text_vector_32", F.when(
        F.col("text_embedding_model") == derive.CURRENT_MODEL,
        V.truncate_vector(F.col("text_vector"), 32, True)))
    return M.migration_progress(migrated, "text_vector_32", ["lang"])


# ---------------------------------------------------------------------------
# batch 6: streaming (availableNow runs over a landed copy of the derived feed)
# ---------------------------------------------------------------------------


def landed_feed(spark, d, replay: bool = False):
    feed = derive.change_feed(T(spark, d, "events"))
    path = ST.land_feed(feed, ST.scratch(spark, "landing"))
    if replay:  # the first three days of the feed arrive again, last
        old = feed.filter(F.col("ts") < F.lit("2024-01-04").cast("timestamp_ntz"))
        old.write.mode("append").parquet(path)   # newer files: read after the rest
    return path


@register("stream_route")
def q_stream_route(spark, d):
    s = ST.stream_route(ST.read_feed(spark, landed_feed(spark, d)), derive.routing_config(spark))
    out = ST.run_to_table(spark, s.select("event_id", "database", "table", "config_name",
                                          "config_order", "text_column", "vector_column"),
                          "stream_route")
    return out


@register("stream_dedup")
def q_stream_dedup(spark, d):
    p = ST.parsed(ST.read_feed(spark, landed_feed(spark, d)))
    s = ST.stream_debounce(p.select("event_id", "table", "row_id", "ts"), ["table", "row_id"],
                           "ts", 3600.0, "event_id long, table string, row_id string, ts timestamp_ntz")
    return ST.run_to_table(spark, s, "stream_dedup")


def _stream_vectors(spark, d, replay):
    out, ck = ST.scratch(spark, "vectors"), ST.scratch(spark, "vectors-ck")
    # several micro-batches in arbitrary file order: the result must not depend on it
    q = ST.stream_vectorize(spark, ST.read_feed(spark, landed_feed(spark, d, replay), 2),
                            derive.routing_config(spark), out, ck, derive.DIMENSION,
                            derive.CURRENT_MODEL)
    q.awaitTermination()
    cur = ST.current_vectors(spark, out)
    return cur.select("table", "row_id", "event_id", "model", V.vsize("vector").alias("dim"),
                      checksum(F.col("vector")).alias("checksum"))


@register("stream_vectorize")
def q_stream_vectorize(spark, d):
    return _stream_vectors(spark, d, False)


@register("stream_late")
def q_stream_late(spark, d):
    return _stream_vectors(spark, d, True)


@register("stream_daily_status")
def q_stream_daily_status(spark, d):
    ev = T(spark, d, "events")
    path = ST.land_feed(ev, ST.scratch(spark, "events-landing"))
    stream = ST.read_feed(spark, path, None, ev.schema)
    s = ST.stream_daily_status(derive.vectorization_log(stream))
    return ST.run_to_table(spark, s, "stream_daily_status", ["table_name", "day"])


@register("stream_retry")
def q_stream_retry(spark, d):
    failed = tasks(spark, d).filter(FAILED_TASKS()).select(
        "id", "retry_count", F.col("completed_at").alias("failed_at"))
    path = ST.scratch(spark, "failed-landing")
    failed.write.parquet(path)
    stream = spark.readStream.schema(failed.schema).parquet(path)
    s = ST.stream_retry(stream, 5.0, 3).select("id", "retry_count", "decision",
                                               "next_retry_count", "delay_s", "retry_at")
    return ST.run_to_table(spark, s, "stream_retry")


@register("stream_retry_timers")
def q_stream_retry_timers(spark, d):
    """The failed tasks as a stream of attempts, in order of time and several micro-batches;
    a last success, far later, lets the watermark pass every timer."""
    failed = tasks(spark, d).filter(FAILED_TASKS()).select(
        "id", "retry_count", F.col("completed_at").alias("failed_at"),
        F.lit("retry").alias("outcome"))
    path = ST.scratch(spark, "attempts-landing")
    ST.land_feed_in_order(failed, path, 4, "failed_at")
    last = failed.agg(F.lit(-1).cast("long").alias("id"), F.lit(0).alias("retry_count"),
                      (F.max("failed_at") + F.expr("INTERVAL 30 DAYS")).alias("failed_at"),
                      F.lit("success").alias("outcome"))
    last.select(*[F.col(f.name).cast(f.dataType) for f in failed.schema]).write.mode(
        "append").parquet(path)
    stream = spark.readStream.schema(failed.schema).option("maxFilesPerTrigger", 8).parquet(path)
    store = spark.conf.get(RT.PROVIDER, None)
    due = RT.retry_timers(stream, ["id"], "failed_at", "id", "failed_at", 5.0, 3)
    out = ST.run_to_table(spark, due, "stream_retry_timers")
    spark.conf.set(RT.PROVIDER, store) if store else spark.conf.unset(RT.PROVIDER)
    again = F.col("decision") == "retry"
    before = F.when(again, F.col("retry_count") - 1).otherwise(F.col("retry_count"))
    s = ER.retry_schedule(F.col("failed_at"), F.col("before"), 5.0, 3)
    return out.withColumn("before", before).withColumn("_s", s).select(
        "id", F.col("before").alias("retry_count"), "decision",
        F.when(again, F.col("retry_count")).alias("next_retry_count"), "_s.delay_s", "_s.retry_at")


@register("batch_plan")
def q_batch_plan(spark, d):
    r = routed_texts(spark, d).select("config_order", "table", "row_id")
    return EM.batch_plan(r, ["config_order"], ["row_id"], 100) \
             .select("table", "row_id", "row_number", "batch_no")


@register("reconcile_summary")
def q_reconcile_summary(spark, d):
    """A6 over reconciliation: per table success / failed (a critical
    collision blocks the table in safe mode), then one summary row."""
    cat = catalog(spark, d)
    r = K.resolve_columns(collisions(spark, d, cat)).withColumn("column_type",
                                                                role_type(F.col("role")))
    plan = K.reconcile_plan(r, cat)
    per_table = plan.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("changes"),
        F.count_if(~F.col("blocked")).alias("ok_changes"),
        F.bool_or("blocked").alias("blocked"))
    st = F.when(F.col("blocked"), "failed").otherwise("success")
    t = per_table.withColumn("status", st)
    return t.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "partial").alias("partial"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("status") == "success").cast("double"),
                                        F.count(F.lit(1)).cast("double")), F.lit(0.0)), 6)
         .alias("success_rate"),
        F.sum("changes").alias("total_changes"),
        F.sum(F.when(F.col("status") == "success", F.col("ok_changes")).otherwise(0))
         .alias("successful_changes"),
        F.count_if(F.col("blocked")).alias("critical_collisions"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") == "failed",
                                                         F.col("table_name")))), ",")
         .alias("failed_tables"))


@register("completeness_report")
def q_completeness_report(spark, d):
    """§3.3 end to end: today's check upserted into the history, then the
    worst-first completion summary of the latest check per target."""
    from . import completeness
    _, summary, _ = completeness.completeness_report(target_null_counts(spark, d),
                                                     history(spark, d), CHECK_TIME, derive.AS_OF)
    return summary.select("table_name", "vector_column", "null_vectors", "total_rows",
                          "completion_percentage", "checked_at", "health_status",
                          "freshness_status")
