"""Wall-clock time helpers.

Event times in the data are TIMESTAMP_NTZ (wall clock, no zone).  Batch
operators keep them that way, so results never depend on the session time
zone.  Streams need a TIMESTAMP (instant) for watermarks and windows:
``event_time`` maps the wall clock to the instant with the same UTC
reading, ``wall_clock`` maps it back — both independent of the session
zone and of daylight-saving jumps.
"""
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = "1970-01-01 00:00:00"


def ntz(value: str) -> Column:
    """A wall-clock literal."""
    return F.lit(value).cast("timestamp_ntz")


def as_column(x) -> Column:
    return x if isinstance(x, Column) else ntz(x)


def epoch_us(c: Column) -> Column:
    """Microseconds of a wall-clock timestamp read as UTC."""
    return F.timestamp_diff("MICROSECOND", ntz(_EPOCH), c.cast("timestamp_ntz"))


def event_time(c: Column) -> Column:
    """Wall clock → TIMESTAMP instant with the same UTC reading (for watermarks)."""
    return F.timestamp_micros(epoch_us(c))


def wall_clock(c: Column) -> Column:
    """TIMESTAMP instant → wall clock of its UTC reading."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), ntz(_EPOCH))


def epoch_date(c: Column) -> Column:
    """Calendar date of a TIMESTAMP instant in UTC."""
    return F.date_from_unix_date(F.floor(F.unix_micros(c) / F.lit(86_400_000_000)).cast("int"))


NTZ = T.TimestampNTZType()
