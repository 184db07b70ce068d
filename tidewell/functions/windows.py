"""Event-time windows anchored at the epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def start_of(ts: Column, seconds: int) -> Column:
    """Start of the half-open window that holds ``ts``; floors also before 1970. Sizes of 0 or less mean a minute."""
    size = (seconds if seconds > 0 else 60) * 1_000_000
    at = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(at - F.pmod(at, F.lit(size)))


def end_of(start: Column, seconds: int) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + (seconds if seconds > 0 else 60) * 1_000_000)
