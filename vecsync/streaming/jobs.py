"""Structured Streaming jobs: ST1–ST6 over the same functions as the batch path.

Source: a change feed ``(event_id, ts, value)`` — files landing in a folder
(or Kafka; same columns).  Every job is restartable from its checkpoint in
the shared ``spark.checkpoint.dir``; sinks are idempotent per micro-batch
(``foreachBatch`` writes ``batch_id=<n>`` with overwrite, so a replayed
batch replaces its own output instead of duplicating it).

``events.ts`` is TIMESTAMP_NTZ (wall clock), which cannot carry a watermark;
stateful streams derive an event-time instant with the same UTC reading
(``functions.time.event_time``), so nothing depends on the session zone.
"""
import hashlib
import os
import uuid
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import clean as C
from ..functions.time import epoch_date, epoch_us, event_time
from ..functions.vectors import is_valid_vector
from ..operators import detect, routing as R
from ..operators.embed import embed_outcomes
from ..session import checkpoint_dir
from ..sources import feed as FD

FEED_SCHEMA = "event_id long, ts timestamp_ntz, value string"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def land_feed(feed: DataFrame, path: str, files: int | None = None, ts_col: str = "ts") -> str:
    """Land a (batch) feed in a folder as time-ranged files (one parallel
    write; the file count follows the shuffle settings and AQE unless
    ``files`` is given).  The file source may pick them up in any order."""
    ranged = feed.repartitionByRange(files, ts_col) if files else feed.repartitionByRange(ts_col)
    ranged.write.mode("errorifexists").parquet(path)
    return path


def land_feed_in_order(feed: DataFrame, path: str, chunks: int = 4, ts_col: str = "ts") -> str:
    """Test fixture: land a small feed the way a live feed arrives — time
    slices appended one after another (the file source orders files by
    modification time).  Only the distinct days pass through the driver."""
    days = [r[0] for r in feed.select(F.to_date(ts_col).alias("d")).distinct()
            .orderBy("d").collect()]
    step = max(1, -(-len(days) // chunks))
    for i in range(0, len(days), step):
        lo, hi = days[i], days[min(i + step, len(days)) - 1]
        feed.filter(F.to_date(ts_col).between(lo, hi)).write.mode("append").parquet(path)
    return path


def read_feed(spark: SparkSession, path: str, files_per_trigger: int | None = None,
              schema: str = FEED_SCHEMA) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def parsed(feed: DataFrame) -> DataFrame:
    """S3 + P4 on a stream; row id / texts pulled from the row objects."""
    return FD.with_row_fields(FD.parse_feed(feed))


# --- ST2 ---------------------------------------------------------------------------

def stream_route(feed: DataFrame, routing: DataFrame) -> DataFrame:
    """ST2: stream ⋈ static routing table; the row id, texts and vector are
    read by each target's configured column names."""
    return FD.with_config_fields(R.route_events(parsed(feed), routing))


# --- ST3 ---------------------------------------------------------------------------

def stream_dedup(events: DataFrame, key: list[str], ts_col: str, delay: str) -> DataFrame:
    """ST3 default: drop repeats of a key within the watermark delay
    (``dropDuplicatesWithinWatermark``; state bounded by the watermark)."""
    return events.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(key)


def stream_debounce(events: DataFrame, key: list[str], ts_col: str, window_seconds: float,
                    out_schema: str, delay: str = "2 hours",
                    bucket_seconds: int = 3600, spread: int = 8) -> DataFrame:
    """ST3 exact: the W3 rule on a stream.  Groups are (hash of the key modulo ``spread``, time
    bucket) with time buckets as in ``detect.debounce``: an event near the end of its bucket
    also goes to the next one as context, so a hot key spreads over many tasks.  A group folds
    its keys together, so the calls grow with the time the feed covers and not with its keys.
    The state holds the last event time seen of each of the group's keys; event-time timeout
    drops it once the watermark passes the last of them.

    Of the events of a key less than a window apart only the first can stay, so a group is
    folded, one Arrow batch after another, into the first event and the last time of each
    window-wide cell of a key: however many events a key has, a task holds one batch and
    ``bucket_seconds / window_seconds`` cells of each key of the group.  An event without a
    time stays."""
    win_us = int(round(window_seconds * 1_000_000))
    size = max(int(bucket_seconds * 1_000_000), win_us, 1)
    cols = [f.split()[0] for f in out_schema.split(",")]
    if win_us <= 0:
        return events.select(*cols)
    events = detect.in_buckets(events.withColumn("_us", epoch_us(F.col(ts_col))), win_us, size)
    # a context copy has no event time: it is never late, so late events are counted once
    events = events.withColumn("_et", F.when(F.col("_own"), event_time(F.col(ts_col))))
    events = events.withColumn("_key", F.to_json(F.struct(*key)))
    events = events.withColumn("_h", F.pmod(F.xxhash64("_key"), F.lit(spread)))
    never = -2 ** 62                        # no event yet: earlier than any

    def fold(x: pd.DataFrame) -> pd.DataFrame:
        """Of each cell of a key the first event and, as ``_last``, the last time."""
        x = x.sort_values(["_key", "_us", cols[0]])
        names, cell = x["_key"].to_numpy(), x["_cell"].to_numpy()
        new = np.r_[True, (names[1:] != names[:-1]) | (cell[1:] != cell[:-1])]
        last = np.maximum.reduceat(x["_last"].to_numpy(), np.flatnonzero(new))
        return x[new].assign(_last=last)

    def fn(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cells = None
        for pdf in pdfs:
            timed = pdf["_us"].notna()
            if not timed.all():
                yield pdf.loc[~timed, cols]
                pdf = pdf[timed]
            if not len(pdf):
                continue
            us = pdf["_us"].astype("int64")
            # context comes from the window before the bucket: cell -1
            cell = (us - pdf["_b"].astype("int64") * size) // win_us
            part = fold(pdf[[*cols, "_key"]].assign(_us=us, _cell=cell, _last=us))
            cells = part if cells is None else fold(pd.concat([cells, part]))
        if cells is None:
            return
        seen = dict(zip(*state.get)) if state.exists else {}
        names, last = cells["_key"].to_numpy(), cells["_last"].to_numpy()
        new = np.r_[True, names[1:] != names[:-1]]
        before = np.where(new, never, np.r_[never, last[:-1]])
        if seen:
            before = np.maximum(before, [seen.get(x, never) for x in names])
        ends = np.r_[new[1:], True]
        for x, at in zip(names[ends], last[ends].tolist()):
            seen[x] = max(seen.get(x, never), at)
        state.update((list(seen), list(seen.values())))
        # a later event of these keys is always kept once the watermark passed
        # last + window, so the state can go then (never before the watermark)
        state.setTimeoutTimestamp(max((max(seen.values()) + win_us) // 1000,
                                      state.getCurrentWatermarkMs()) + 1)
        keep = (cells["_cell"].to_numpy() >= 0) & (cells["_us"].to_numpy() - before >= win_us)
        if keep.any():
            yield cells.loc[keep, cols]

    return (events.withWatermark("_et", delay).groupBy("_h", "_b")
            .applyInPandasWithState(fn, out_schema, "keys array<string>, last_us array<long>",
                                    "append", GroupStateTimeout.EventTimeTimeout))


# --- ST1 / ST6 ---------------------------------------------------------------------

def vectorize_changes(routed: DataFrame, dimension: int, model: str, provider: str = "mock",
                      **config) -> DataFrame:
    """Per micro-batch: P1 → F6 → P3 → W4 → UD1 → P8: one attempt per row that needs a
    vector, with its outcome (a pure function of the batch but for the provider).

    Only events that need a vector compete for "newest per row", so the
    result over many batches equals the batch job over the whole feed.
    """
    need = detect.needs_vectorization(F.col("operation"), F.col("new_vector"),
                                      F.col("old_text"), F.col("new_text"))
    x = routed.filter(need).withColumn(
        "clean", R.clean_by_config(F.col("new_text"), F.col("cleaning_enabled"),
                                   F.col("cleaning_config")))
    x = x.filter(C.basic_clean(F.col("new_text")) != "").filter(F.col("clean") != "")
    x = detect.latest_per_key(x, ["table", "row_id"], "ts", ["event_id"])
    return attempt(x.select("event_id", "ts", "table", "row_id", "clean",
                            F.lit(0).alias("retry_count")), dimension, model, provider, **config)


def attempt(x: DataFrame, dimension: int, model: str, provider: str, **config) -> DataFrame:
    """Embed ``clean``; a vector of the wrong kind is a failure that will not mend."""
    e = embed_outcomes(x, "clean", provider, dimension=dimension, **config)
    bad = (F.col("outcome") == "success") & ~is_valid_vector(F.col("vector"), dimension)
    return e.select(*x.columns, F.when(~bad, F.col("vector")).alias("vector"),
                    F.when(bad, "dead").otherwise(F.col("outcome")).alias("outcome"),
                    F.when(bad, "invalid vector").otherwise(F.col("message")).alias("message"),
                    F.lit(model).alias("model"))


def _run_id(checkpoint: str) -> str:
    """Names a query's outputs: the same after a restart, another for another checkpoint."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def stream_vectorize(spark: SparkSession, feed: DataFrame, routing: DataFrame, out_path: str,
                     checkpoint: str, dimension: int, model: str, provider: str = "mock",
                     trigger: dict | None = None, **config):
    """ST1: continuous change processing with an idempotent upsert.

    Each micro-batch keeps the newest event per (table, row) that needs a
    vector (W4), embeds it and writes all attempts (S5) to
    ``out_path/attempts/run=<id>/batch_id=<n>`` and the malformed events (S8)
    to ``out_path/rejects/...``.  Overwriting them makes a replayed batch
    harmless; the run id comes from the checkpoint, so a new checkpoint adds to
    the sink and never replaces what an earlier one wrote.  Vectors, dead
    letters (S7) and retries (ST4) are read from the attempts.  Late / replayed
    events lose against newer ones (ST6) because event time decides.

    ``trigger`` is passed to ``DataStreamWriter.trigger`` (default: all that is
    there, then stop); ``provider`` and ``config`` name the embedder.
    """
    run = _run_id(checkpoint)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        place = f"run={run}/batch_id={batch_id}"
        batch.persist()
        try:
            out = vectorize_changes(stream_route(batch, routing), dimension, model, provider,
                                    **config)
            out.write.mode("overwrite").parquet(os.path.join(out_path, "attempts", place))
            FD.feed_rejects(batch).write.mode("overwrite").parquet(
                os.path.join(out_path, "rejects", place))
        finally:
            batch.unpersist()

    return (feed.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


ATTEMPTS = ("event_id long, ts timestamp_ntz, table string, row_id string, clean string, "
            "retry_count int, vector array<float>, outcome string, message string, model string, "
            "run string, batch_id long")


def attempts(spark: SparkSession, out_path: str) -> DataFrame:
    """Every attempt of every batch; empty before the first one."""
    path = os.path.join(out_path, "attempts")
    os_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = os_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(os_path):
        return spark.createDataFrame([], ATTEMPTS)
    return spark.read.schema(ATTEMPTS).parquet(path)


def _newest(df: DataFrame) -> DataFrame:
    return detect.latest_per_key(df, ["table", "row_id"], "ts", ["event_id", "retry_count"])


def current_vectors(spark: SparkSession, out_path: str, snapshot: str | None = None) -> DataFrame:
    """The upserted state: newest vector per (table, row_id) over all batches.  With a
    ``snapshot`` (``compact_vectors``) only that and the batches after it are read."""
    every = attempts(spark, out_path)
    cols = ["event_id", "ts", "table", "row_id", "clean", "vector", "model", "retry_count"]
    if snapshot is None:
        return _newest(every.filter(F.col("outcome") == "success").select(*cols))
    # one row per run: conditions on partition columns, so folded batches are not read
    for r in spark.read.parquet(os.path.join(snapshot, "folded")).collect():
        every = every.filter((F.col("run") != r.run) | (F.col("batch_id") > r.last))
    old = spark.read.parquet(os.path.join(snapshot, "vectors")).select(*cols)
    return _newest(every.filter(F.col("outcome") == "success").select(*cols).unionByName(old))


def compact_vectors(spark: SparkSession, out_path: str, snapshot_path: str,
                    previous: str | None = None) -> None:
    """Fold the attempts so far (and an earlier snapshot) into a new one that
    ``current_vectors`` reads: the newest vector per row, and the last batch of each run
    that is in it.  Writes a new folder; never one being read."""
    last = attempts(spark, out_path).groupBy("run").agg(F.max("batch_id").alias("last"))
    # which batches are in it is fixed first: one that arrives meanwhile may be in it and is
    # read again after it, which changes nothing
    last.write.mode("errorifexists").parquet(os.path.join(snapshot_path, "folded"))
    every = current_vectors(spark, out_path, previous)
    every.write.mode("errorifexists").parquet(os.path.join(snapshot_path, "vectors"))


def _latest_attempts(spark: SparkSession, out_path: str) -> DataFrame:
    w = Window.partitionBy("table", "row_id").orderBy(
        F.col("ts").desc(), F.col("event_id").desc(), F.col("retry_count").desc())
    return (attempts(spark, out_path).withColumn("_rn", F.row_number().over(w))
            .filter("_rn = 1").drop("_rn"))


def dead_letters(spark: SparkSession, out_path: str) -> DataFrame:
    """Rows whose newest attempt will not be tried again."""
    return _latest_attempts(spark, out_path).filter(F.col("outcome") == "dead")


RETRY_KEY = ["table", "row_id", "event_id", "retry_count"]


def _claims(spark: SparkSession, out_path: str) -> DataFrame:
    """The retries that runs have taken on: the key of each, the run and when."""
    schema = ("table string, row_id string, event_id long, retry_count int, clean string, "
              "ts timestamp_ntz, claimed_at timestamp, run string")
    path = os.path.join(out_path, "claims")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def run_retries(spark: SparkSession, out_path: str, as_of: str, dimension: int, model: str,
                provider: str = "mock", retry_delay: float = 1.0, max_retries: int = 3,
                lease_seconds: float = 3600.0, **config) -> int:
    """ST4: read the retries back, try those that are due at ``as_of`` once more, and add the
    attempts to the sink; after ``max_retries`` a row becomes a dead letter.  Returns how many
    were due.  A row with a newer event has moved on and is left alone.

    A run writes what it takes on (its claim) before it calls a provider, and leaves out what
    another run has claimed within ``lease_seconds`` and not finished, so runs at the same time
    do not send a row twice; of two that claim a row at once neither sends it, and the next run
    after the lease does.  The texts are read from the claim, the attempts written once.
    """
    from ..functions.errors import retry_schedule
    run = f"retry-{uuid.uuid4().hex[:12]}"
    failed = _latest_attempts(spark, out_path).filter(F.col("outcome") == "retry")
    s = retry_schedule(F.col("ts"), F.col("retry_count"), retry_delay, max_retries)
    plan = failed.withColumn("_s", s).filter(
        (F.col("_s.decision") == "dead")
        | (F.col("_s.retry_at") <= F.lit(as_of).cast("timestamp_ntz")))
    again = plan.filter(F.col("_s.decision") == "retry").select(
        "event_id", "ts", "table", "row_id", "clean",
        (F.col("retry_count") + 1).alias("retry_count"))
    claim = os.path.join(out_path, "claims", f"run={run}")
    # in a plan of its own: what a job reads must not be what it writes
    mine = again.withColumn("claimed_at", F.current_timestamp())
    mine.write.mode("errorifexists").parquet(claim)
    held = _claims(spark, out_path).filter(
        (F.col("run") != run) & (F.col("claimed_at") > F.current_timestamp()
                                 - F.make_dt_interval(secs=F.lit(float(lease_seconds)))))
    done = attempts(spark, out_path).select(*RETRY_KEY)
    held = held.select(*RETRY_KEY).join(done, RETRY_KEY, "left_anti")
    own = (_claims(spark, out_path).filter(F.col("run") == run)
           .join(held, RETRY_KEY, "left_anti").select(*again.columns))
    tried = attempt(own, dimension, model, provider, **config)
    over = plan.filter(F.col("_s.decision") == "dead").select(
        "event_id", "ts", "table", "row_id", "clean",
        (F.col("retry_count") + 1).alias("retry_count"), "vector", F.lit("dead").alias("outcome"),
        "message", "model")
    place = os.path.join(out_path, "attempts", f"run={run}/batch_id=0")
    tried.unionByName(over).write.mode("errorifexists").parquet(place)
    return spark.read.parquet(place).count()


# --- ST4 ---------------------------------------------------------------------------

def stream_retry(failed: DataFrame, retry_delay: float, max_retries: int) -> DataFrame:
    """ST4: failed attempts (a second stream source) get their next schedule
    (F17) or the dead-letter decision; the sink splits on ``decision``."""
    from ..functions.errors import retry_schedule
    s = retry_schedule(F.col("failed_at"), F.col("retry_count"), retry_delay, max_retries)
    return failed.withColumn("_s", s).select("*", "_s.*").drop("_s")


# --- ST5 ---------------------------------------------------------------------------

def stream_daily_status(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST5: per (table, day) tumbling window of the vectorization log."""
    return (log.withColumn("_et", event_time(F.col("created_at")))
               .withWatermark("_et", delay)
               .groupBy("table_name", F.window("_et", "1 day"))
               .agg(F.count(F.lit(1)).alias("total"),
                    F.count_if(F.col("status") == "success").alias("successful"),
                    F.count_if(F.col("status") != "success").alias("not_vectorized"))
               .select("table_name", epoch_date(F.col("window.start")).alias("day"), "total",
                       "successful", "not_vectorized"))


def run_to_table(spark: SparkSession, stream: DataFrame, name: str,
                 key: list[str] | None = None) -> DataFrame:
    """Drive a stream to completion (availableNow) into Parquet under the
    shared checkpoint dir and read the result back as a batch DataFrame.

    With a ``key`` (aggregations) the stream runs in ``update`` mode: a batch
    writes only the rows it changed, the newest row of a key counts, and the
    watermark ends the state of closed windows.  Otherwise rows are appended.
    """
    path, ck = scratch(spark, f"{name}-out"), scratch(spark, f"{name}-ck")
    w = stream.writeStream.option("checkpointLocation", ck)
    if key:
        w = w.outputMode("update").foreachBatch(
            lambda b, n: b.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={n}")))
    else:
        w = w.outputMode("append").format("parquet").option("path", path)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(path)
    return detect.latest_per_key(out, key, "batch_id").drop("batch_id") if key else out


def rows_dropped_by_watermark(query) -> int:
    """ST6: events that arrived after the watermark had passed them, summed
    over the query's progress reports (stateful operators only)."""
    total = 0
    for p in query.recentProgress or []:
        for op in p.get("stateOperators", []) if isinstance(p, dict) else p.stateOperators:
            v = op.get("numRowsDroppedByWatermark", 0) if isinstance(op, dict) \
                else op.numRowsDroppedByWatermark
            total += int(v or 0)
    return total
