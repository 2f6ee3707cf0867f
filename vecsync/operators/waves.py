"""F16/UD1 with feedback: rows are sent in waves, and a wave's refusals set the next one's size.

Pending rows are numbered into slots of about ``rows_per_task`` by a hash of their id and
written once, in folders of ``BLOCK`` slots.  A wave takes the next ``concurrency`` slots and runs them in as many tasks, so
that many requests are under way at once.  Its rows are written with their outcomes; then

    no refusal for the rate (429)   concurrency + 1 (at most ``most``)
    any refusal                     concurrency halved (at least 1)

Rows that may be tried again make up the next pass, until none is left or ``passes`` are over.
A wave is one Spark job over its own slots; its tasks count what they sent, and the driver sees
counts only.  Waves wait for each other's requests and for nothing else: while one runs, the next
slots are fetched, both plans the next wave may have are made, and earlier outcomes are written,
``WRITTEN`` waves at a time.
"""
from __future__ import annotations

import math
from concurrent.futures import Future, ThreadPoolExecutor
from functools import partial, reduce

from pyspark import AccumulatorParam, StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embed import embed_outcomes


#: Slots in a folder: what a wave opens is as much however many rows are pending.
BLOCK = 16
#: Slots that are kept at hand, and the parts they are dealt into: up to a third as many tasks
#: take whole parts, more tasks get their rows by a shuffle.
GROUP, PARTS = 4 * BLOCK, 24
#: Waves whose rows are written together.
WRITTEN = 8


def next_concurrency(now: int, refused: int, most: int) -> int:
    """Additive increase, multiplicative decrease."""
    return max(1, now // 2) if refused else min(most, now + 1)


class WaveCounts(AccumulatorParam):
    """{wave: (tasks that are done, rows, rows refused for the rate)}."""

    def zero(self, value):
        return {}

    def addInPlace(self, value1, value2):
        for wave, counts in value2.items():
            value1[wave] = tuple(map(sum, zip(value1.get(wave, (0, 0, 0)), counts)))
        return value1


class _Slots:
    """The pending rows of a pass, by slot.  Groups of ``GROUP`` slots, each dealt evenly into
    ``PARTS``, are cached one ahead of the waves."""

    def __init__(self, pending: DataFrame, slots: int, pool: ThreadPoolExecutor):
        self.pending, self.slots, self.pool = pending, slots, pool
        self.groups: dict[int, tuple[DataFrame, Future]] = {}

    def _fetch(self, group: int) -> None:
        at = group * GROUP
        if group in self.groups or at >= self.slots:
            return
        # the blocks are folders: the others are not opened
        rows = (self.pending.filter(F.col("block").between(at // BLOCK, (at + GROUP - 1) // BLOCK))
                .drop("block").repartition(PARTS).persist())
        count = inheritable_thread_target(self.pending.sparkSession)(rows.count)
        self.groups[group] = rows, self.pool.submit(count)

    def hold(self, at: int, to: int) -> None:
        """Fetches the groups of the slots ``at`` to ``to`` and the next one; lets go of those
        before."""
        for old in [g for g in self.groups if g < at // GROUP]:
            self.drop(old)
        for group in range(at // GROUP, to // GROUP + 2):
            self._fetch(group)

    def take(self, at: int, tasks: int) -> DataFrame:
        """The rows of the slots ``at`` to ``at + tasks - 1`` in ``tasks`` partitions."""
        last = min(at + tasks, self.slots) - 1
        # as an array the numbers are no part of the generated code, which so stays the same
        own = F.array_contains(F.sequence(F.lit(at), F.lit(last)), F.col("slot"))
        rows = reduce(DataFrame.union, [self.groups[g][0].filter(own)
                                        for g in range(at // GROUP, last // GROUP + 1)])
        return rows.coalesce(tasks) if 3 * tasks <= PARTS else rows.repartition(tasks)

    def drop(self, group: int) -> None:
        rows, count = self.groups.pop(group)
        count.result()
        rows.unpersist()


class _Wave:
    """The rows of a wave, planned but not sent.  ``send`` runs them once and keeps the outcomes on
    two executors until they are written: nothing sends them again, and one executor may be lost."""

    def __init__(self, rows: DataFrame, tasks: int):
        self.rows, self.tasks = rows.localCheckpoint(False, StorageLevel.MEMORY_AND_DISK_2), tasks
        self._run = self.rows._jdf.queryExecution().toRdd()

    def send(self) -> None:
        self._run.count()

    def release(self) -> None:
        self.rows._jdf.logicalPlan().rdd().unpersist(False)


def embed_in_waves(df: DataFrame, id_col: str, text_col: str, path: str, provider: str = "mock",
                   start: int = 4, most: int = 64, rows_per_task: int = 1_000,
                   passes: int = 10, **config) -> tuple[DataFrame, DataFrame]:
    """(rows, waves): ``id``, vector, outcome, message of every row's last try, and the history
    (pass, wave, concurrency, rows, refused).  All steps are written below the new shared
    folder ``path``."""
    spark: SparkSession = df.sparkSession
    todo = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    concurrency, wave, history, tried = start, 0, [], []
    counts = spark.sparkContext.accumulator({}, WaveCounts())
    again = F.col("outcome") == "retry"

    def plan(pending: _Slots, at: int, tasks: int, wave: int) -> _Wave:
        got = embed_outcomes(pending.take(at, tasks), "_text", provider,
                             at_end=partial(_count, counts, wave), **config)
        return _Wave(got.withColumn("_text", F.when(again, F.col("_text"))), tasks)

    def write(sent: list[_Wave], place: str) -> None:
        together = reduce(DataFrame.union, [x.rows for x in sent])
        together.coalesce(max(x.tasks for x in sent)).write.parquet(place)
        for x in sent:
            x.release()

    with ThreadPoolExecutor(6) as pool:
        def run(f, *args) -> Future:
            return pool.submit(inheritable_thread_target(spark)(f), *args)

        for turn in range(passes):
            n = todo.count()
            if not n:
                break
            slots = math.ceil(n / rows_per_task)
            slot = F.pmod(F.xxhash64(id_col, F.lit(turn)), F.lit(slots)).cast("int")
            place = f"{path}/pending/pass={turn}"
            block = F.floor(F.col("slot") / BLOCK).cast("int")
            (todo.withColumn("slot", slot).withColumn("block", block).repartition("block")
             .sortWithinPartitions("block", "slot").write.partitionBy("block").parquet(place))
            pending = _Slots(spark.read.parquet(place), slots, pool)
            at, plans, sent, written = 0, {}, [], None
            while at < slots:
                # as many tasks as slots: what is under way at once
                if concurrency not in plans:
                    pending.hold(at, at + concurrency)
                    plans[concurrency] = run(plan, pending, at, concurrency, wave)
                sent.append(plans[concurrency].result())
                job, after = run(sent[-1].send), at + concurrency
                pending.hold(at, after + concurrency + 1)
                plans = {c: run(plan, pending, after, c, wave + 1) for c in
                         {next_concurrency(concurrency, r, most) for r in (0, 1)} if after < slots}
                job.result()
                _, rows, refused = counts.value.get(wave, (0, 0, 0))
                history.append((turn, wave, concurrency, rows, refused))
                at, wave = after, wave + 1
                concurrency = next_concurrency(concurrency, refused, most)
                if len(sent) == WRITTEN or at >= slots:
                    if written:
                        written.result()
                    written = run(write, sent, f"{path}/tried/pass={turn}/wave={wave - 1}")
                    sent = []
            written.result()
            for group in list(pending.groups):
                pending.drop(group)
            done = spark.read.parquet(f"{path}/tried/pass={turn}").drop("wave")
            last = turn + 1 == passes
            tried.append(done if last else done.filter("outcome <> 'retry'"))
            todo = done.filter("outcome = 'retry'").select(id_col, "_text")
    waves = spark.createDataFrame(history, "pass int, wave int, concurrency int, rows long, "
                                           "refused long")
    rows = embed_outcomes(df.limit(0).select(id_col, F.col(text_col).alias("_text"),
                                             F.lit(0).alias("slot")), "_text", provider, **config)
    for part in tried:
        rows = rows.unionByName(part)
    return rows.select(id_col, "vector", "outcome", "message"), waves


def _count(counts, wave: int, rows: int, refused: int) -> None:
    counts.add({wave: (1, rows, refused)})
