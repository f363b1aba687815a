"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less (UTC) timestamp."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), ts.cast("timestamp_ntz"))


def epoch_millis(ts: Column) -> Column:
    return F.floor(epoch_micros(ts) / 1000).cast("bigint")


def from_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH))


_UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000}
_UNITS |= {"day": 86_400_000_000, "week": 604_800_000_000}


def interval_micros(text: str) -> int:
    """Microseconds of a length of time such as `5 minutes` or `1 hour 30 minutes`."""
    words = text.split()
    return sum(int(n) * _UNITS[unit.lower().removesuffix("s")] for n, unit in zip(words[::2], words[1::2], strict=True))
