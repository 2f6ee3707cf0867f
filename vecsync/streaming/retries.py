"""ST4 as a running stream: failed attempts wait in state and come back by timer.

A key (a task, or a row of a table) holds in state the failure that waits, which of its
retries was asked for, and the time its schedule (F17) names; keys share the state and the
timer of a group, which stands at the earliest of their times.  The timer gives a row out once; the next outcome of that retry, read from the same stream of attempts, either
ends the key's state (success, dead) or sets the next timer.  A failure whose retries are used
up is given out at once as dead.  A newer event of a key replaces what waits; an older or
repeated one changes nothing.  A retry whose outcome never comes is forgotten after a while,
so state ends in every case.

Time is the event time of the attempts (a watermark fires the timers; a replay gives the same
rows at the same times) or the clock, with the delay counted from a failure's arrival.

``run_retry_stream`` closes the loop: due rows are written (claimed) per micro-batch before a
provider sees them, embedded, and added to the attempts that the stream reads.  A replayed
batch whose attempts are there is not sent again.
"""
from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.errors import retry_schedule
from ..functions.time import epoch_us, event_time
from ..session import checkpoint_dir
from . import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DAY_MS = 86_400_000

#: Times in payloads keep their microseconds.
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
          "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: What a group of keys holds: one element of the arrays for each key that waits or was given
#: out, and the one timer that is set.
WAITING = ("keys array<string>, event_us array<long>, event_id array<long>, "
           "retry_count array<int>, due_ms array<long>, sent array<boolean>, "
           "payload array<string>, timer_ms long")
#: Groups that the keys are dealt to by a hash: calls grow with the batches, not with the keys.
GROUPS = 256
OUT = ["decision", "retry_count", "fired_ms", "payload"]


class RetryTimers(StatefulProcessor):
    """State and timer of a group of keys; rows in: key_, outcome, decision, event_us, event_id,
    retry_count, due_ms (event time) or delay_ms (clock), payload.

    The group's timer stands at the earliest time of its keys and, when it fires, gives out all
    that are due."""

    def __init__(self, clock: bool, forget_ms: int):
        self.clock, self.forget_ms = clock, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", WAITING)

    def _load(self) -> tuple[dict, int | None]:
        """Per key: event_us, event_id, retry_count, due_ms, sent, payload; and the timer."""
        got = self.waiting.get() if self.waiting.exists() else None
        if got is None:
            return {}, None
        return dict(zip(got[0], zip(*got[1:7]))), got[7]

    def _store(self, held: dict, timer: int | None, fired: bool = False) -> None:
        due = min((h[3] for h in held.values()), default=None)
        if timer is not None and timer != due and not fired:
            self.handle.deleteTimer(timer)
        if due is not None and (fired or timer != due):
            self.handle.registerTimer(due)
        if held:
            self.waiting.update((list(held), *map(list, zip(*held.values())), due))
        else:
            self.waiting.clear()

    @staticmethod
    def _out(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=OUT)
        return out.assign(fired_ms=out["fired_ms"].astype("Int64"))

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs() if self.clock else 0
        held, timer = self._load()
        for pdf in rows:
            pdf = pdf.sort_values(["event_us", "event_id", "retry_count"], kind="stable")
            dead = []
            for r in pdf.itertuples(index=False):
                event, own = (int(r.event_us), int(r.event_id)), int(r.retry_count)
                old = held.get(r.key_)
                if old is not None:
                    before = (old[0], old[1])
                    if event < before or event == before and r.outcome == "retry" \
                            and own <= old[2]:
                        continue                        # moved on, or a repeat
                if r.outcome != "retry" or r.decision == "dead":
                    held.pop(r.key_, None)
                    if r.outcome == "retry":
                        dead.append(("dead", own, None, r.payload))
                    continue
                due = now + int(r.delay_ms) if self.clock else int(r.due_ms)
                held[r.key_] = (*event, own, due, False, r.payload)
            if dead:
                yield self._out(dead)
        self._store(held, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = (timerValues.getCurrentProcessingTimeInMs() if self.clock
               else timerValues.getCurrentWatermarkInMs())
        fired = expiredTimerInfo.getExpiryTimeInMs()
        held, timer = self._load()
        given = []
        for k, (us, event, own, due, sent, payload) in list(held.items()):
            if due > fired and due >= now:
                continue
            if sent:                                    # no outcome came
                del held[k]
                continue
            held[k] = (us, event, own, due + self.forget_ms, True, None)
            given.append(("retry", own + 1, due, payload))
        self._store(held, timer, timer == fired)
        if given:
            yield self._out(given)

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and typed state need the RocksDB store; a session that names a store of its own
    keeps it.  A running query goes on with the store it was started with."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKS)


def retry_timers(outcomes: DataFrame, key: list[str], event_ts: str, event_id: str,
                 failed_at: str, retry_delay: float, max_retries: int, clock: bool = False,
                 delay: str = "1 minute", forget_ms: int = 7 * DAY_MS) -> DataFrame:
    """The due retries and the dead of a stream of attempts (outcome, retry_count and the
    columns named): key, decision, retry_count (of the retry that is due, or of the last
    failure), fired_ms (when the timer gave it out; null for the dead) and the attempt's other
    columns as they were.

    ``event_ts`` and ``event_id`` order the events of a key; ``failed_at`` is where a delay
    starts in event time, and what the watermark follows at ``delay``, as all outcomes advance
    it; an outcome from before the watermark is late and dropped.
    """
    use_rocksdb(outcomes.sparkSession)
    rest = [c for c in outcomes.columns if c not in key]
    name = F.to_json(F.struct(*key), MICROS)
    s = retry_schedule(F.col(failed_at), F.col("retry_count"), retry_delay, max_retries)
    x = outcomes.withColumn("_s", s).withColumn("_et", event_time(F.col(failed_at)))
    due = F.floor((epoch_us(F.col("_s.retry_at")) + 999) / 1000)
    x = x.withWatermark("_et", delay) if not clock else x
    x = x.select(
        F.pmod(F.xxhash64(name), F.lit(GROUPS)).alias("group_"), name.alias("key_"), "outcome", F.col("_s.decision").alias("decision"),
        epoch_us(F.col(event_ts)).alias("event_us"),
        F.col(event_id).cast("long").alias("event_id"), F.col("retry_count").cast("int"),
        F.coalesce(due, F.lit(0)).cast("long").alias("due_ms"),
        F.coalesce(F.col("_s.delay_s") * 1000, F.lit(0)).cast("long").alias("delay_ms"),
        F.to_json(F.struct(*key, *rest), MICROS).alias("payload"), *([] if clock else ["_et"]))
    kinds = {f.name: f.dataType for f in outcomes.schema.fields}
    got = x.groupBy("group_").transformWithStateInPandas(
        RetryTimers(clock, forget_ms),
        "decision string, retry_count int, fired_ms long, payload string", "Append",
        "ProcessingTime" if clock else "EventTime")
    as_was = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in [*key, *rest])
    return got.select(*OUT[:3], F.from_json("payload", as_was, MICROS).alias("_p")).select(
        *[F.col("_p").getField(c).alias(c) for c in key], *OUT[:3],
        *[F.col(f"_p.{c}") for c in rest if c != "retry_count"])


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def run_retry_stream(spark: SparkSession, out_path: str, checkpoint: str, dimension: int,
                     model: str, provider: str = "mock", retry_delay: float = 1.0,
                     max_retries: int = 3, trigger: dict | None = None,
                     forget_ms: int = 7 * DAY_MS, **config):
    """Retry what fails in the attempts of ``out_path`` (``jobs.stream_vectorize``) for as long
    as the returned query runs: by the clock, each retry once, the used-up ones as dead."""
    checkpoint_dir(spark)
    run = "retry-" + jobs._run_id(checkpoint)
    seen = (spark.readStream.schema(jobs.ATTEMPTS).parquet(os.path.join(out_path, "attempts"))
            .select("table", "row_id", "event_id", "ts", "clean", "retry_count", "outcome",
                    "message"))
    due = retry_timers(seen, ["table", "row_id"], "ts", "event_id", "ts", retry_delay,
                       max_retries, clock=True, forget_ms=forget_ms)

    def send(batch: DataFrame, batch_id: int) -> None:
        claim, place = (os.path.join(out_path, kind, f"run={run}", f"batch_id={batch_id}")
                        for kind in ("claims", "attempts"))
        # the batch is run in every case, since running it is what commits its state
        if _there(spark, place) or _there(spark, claim):
            batch.write.format("noop").mode("overwrite").save()
        else:
            batch.write.mode("overwrite").parquet(claim)
        if _there(spark, place):
            return
        rows = spark.read.schema(batch.schema).parquet(claim)
        if rows.isEmpty():
            return
        own = ["event_id", "ts", "table", "row_id", "clean", "retry_count"]
        tried = jobs.attempt(rows.filter("decision = 'retry'").select(*own), dimension, model,
                             provider, **config)
        over = rows.filter("decision = 'dead'").select(
            *own[:-1], (F.col("retry_count") + 1).alias("retry_count"),
            F.lit(None).cast("array<float>").alias("vector"), F.lit("dead").alias("outcome"),
            "message", F.lit(model).alias("model"))
        tried.unionByName(over).write.mode("overwrite").parquet(place)

    return (due.writeStream.foreachBatch(send).outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "10 seconds"})).start())
