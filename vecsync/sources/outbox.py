"""S3 from an outbox table: a streaming source whose offsets are commit ids.

An outbox is an append-only table (commit_id, event_id, ts, value) that the writing side
fills in the transaction that changes a row; commit ids become visible in ascending order.
``read_feed_outbox`` reads it as a stream: an offset is the last commit id read, a micro-batch
is a range of ids, and it is cut into id ranges that executors read on their own.  The range
of a batch stands in the query's checkpoint, so a restart reads an unfinished batch again as
it was and goes on after the last finished one; nothing is lost or repeated.

The table is either

    parquet   a folder of Parquet files on any file system that pyarrow opens (the driver
              reads the bounds of new files from their footers), or
    dbapi     a table of a database, through a DB-API module that executors can import
              (``module``, ``connect``: its arguments as JSON, ``table``)
"""
from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "commit_id long, event_id long, ts timestamp_ntz, value string"
COLUMNS = ["commit_id", "event_id", "ts", "value"]
#: Bytes of a row group that ``append_outbox`` writes: an id range reads whole groups, so large
#: ones would be read again for every range inside.
ROW_GROUP = 2 << 20


@dataclass
class Range(InputPartition):
    """Commit ids after ``start`` up to ``end``; of one file, if the table is files."""

    start: int
    end: int
    file: str | None = None


class _Files:
    """A folder of Parquet files."""

    def __init__(self, options: dict):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(options["path"]) \
            if "://" in options["path"] or options["path"].startswith("file:") \
            else (fs.LocalFileSystem(), options["path"])
        self.bounds: dict[str, tuple[int, int]] = {}

    def _look(self) -> None:
        """The least and largest commit id of every file not seen before."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        for info in self.fs.get_file_info(fs.FileSelector(self.root, recursive=True,
                                                          allow_not_found=True)):
            hidden = any(x[:1] in "_." for x in info.path[len(self.root):].split("/") if x)
            if hidden or not info.is_file or info.path in self.bounds:
                continue
            with self.fs.open_input_file(info.path) as f:
                meta = pq.read_metadata(f)
            at = meta.schema.names.index("commit_id")
            stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
            if stats:
                self.bounds[info.path] = (min(s.min for s in stats), max(s.max for s in stats))

    def last(self) -> int:
        self._look()
        return max((hi for _, hi in self.bounds.values()), default=0)

    def ranges(self, start: int, end: int, rows: int) -> list[Range]:
        self._look()
        out = []
        for path, (lo, hi) in sorted(self.bounds.items()):
            lo, hi = max(lo - 1, start), min(hi, end)
            out += [Range(a, min(a + rows, hi), path) for a in range(lo, hi, rows)]
        return out

    def read(self, part: Range):
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        with self.fs.open_input_file(part.file) as f:
            file = pq.ParquetFile(f)
            at = file.metadata.schema.names.index("commit_id")
            groups = []
            for i in range(file.metadata.num_row_groups):
                s = file.metadata.row_group(i).column(at).statistics
                if s.max > part.start and s.min <= part.end:
                    groups.append(i)
            for batch in file.iter_batches(8192, row_groups=groups, columns=COLUMNS):
                ids = batch["commit_id"]
                yield batch.filter(pc.and_(pc.greater(ids, part.start),
                                           pc.less_equal(ids, part.end)))


class _Database:
    """A table of a database, by a DB-API module."""

    def __init__(self, options: dict):
        self.options = options
        self.table = options["table"]
        if not re.fullmatch(r"\w+(\.\w+)?", self.table):
            raise ValueError(f"not a table name: {self.table!r}")

    def _rows(self, sql: str, *values) -> Iterator[tuple]:
        module = importlib.import_module(self.options["module"])
        mark = {"qmark": "?", "numeric": ":1", "format": "%s", "pyformat": "%s"}[module.paramstyle]
        own = module.connect(**json.loads(self.options.get("connect", "{}")))
        try:
            cursor = own.cursor()
            cursor.execute(sql.replace("?", mark), values)
            while rows := cursor.fetchmany(4096):
                yield from rows
        finally:
            own.close()

    def last(self) -> int:
        return next(self._rows(f"SELECT max(commit_id) FROM {self.table}"))[0] or 0

    def ranges(self, start: int, end: int, rows: int) -> list[Range]:
        return [Range(a, min(a + rows, end)) for a in range(start, end, rows)]

    def read(self, part: Range):
        from datetime import datetime

        for commit, event, ts, value in self._rows(
                f"SELECT {', '.join(COLUMNS)} FROM {self.table} "
                "WHERE commit_id > ? AND commit_id <= ? ORDER BY commit_id", part.start, part.end):
            yield commit, event, datetime.fromisoformat(ts) if isinstance(ts, str) else ts, value


class OutboxReader(DataSourceStreamReader):
    """Offsets are commit ids; a batch is the ids after one up to another."""

    def __init__(self, options: dict):
        self.options = options
        self.rows = int(options.get("rowsperpartition", options.get("rowsPerPartition", 100_000)))
        self.table = (_Database if "module" in options else _Files)(options)

    def initialOffset(self) -> dict:
        return {"commit_id": int(self.options.get("after", 0))}

    def latestOffset(self) -> dict:
        return {"commit_id": max(self.initialOffset()["commit_id"], int(self.table.last()))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.table.ranges(start["commit_id"], end["commit_id"], self.rows)

    def read(self, partition: Range):
        return self.table.read(partition)

    def commit(self, end: dict) -> None:
        pass


class OutboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> OutboxReader:
        return OutboxReader(dict(self.options))


def read_feed_outbox(spark: SparkSession, after: int = 0, rows_per_partition: int = 100_000,
                     **options: str) -> DataFrame:
    """S3 as a stream of (event_id, ts, value): ``path`` of a Parquet outbox, or ``module``,
    ``connect`` and ``table`` of one in a database.  ``after``: the commit id to start after."""
    spark.dataSource.register(OutboxSource)
    r = spark.readStream.format("outbox").option("after", str(after))
    for k, v in {**options, "rowsPerPartition": str(rows_per_partition)}.items():
        r = r.option(k, v)
    return r.load().select("event_id", "ts", "value")


def append_outbox(feed: DataFrame, path: str, after: int = 0) -> int:
    """Add a batch of events (event_id, ts, value) to a Parquet outbox, numbered in order of
    time from ``after + 1`` on, without ordering them in one task; the last number."""
    from ..operators.embed import batch_plan

    rows = batch_plan(feed, [], ["ts", "event_id"], 1)
    out = rows.select((F.col("row_number") + after).alias("commit_id"), "event_id", "ts", "value")
    (out.repartitionByRange("commit_id").sortWithinPartitions("commit_id")
     .write.mode("append").option("parquet.block.size", str(ROW_GROUP)).parquet(path))
    return after + feed.count()
