"""Durations and time conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Microseconds per unit.
MICROS = {
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}


def micros(duration: str) -> int:
    """``"5 minutes"`` as microseconds."""
    amount, unit = duration.split()
    return int(amount) * MICROS[unit.rstrip("s")]


def from_micros(length: int) -> str:
    return f"{length} microseconds"


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def from_epoch_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def parse_iso(text: Column) -> Column:
    """An ISO date or date-time as a timestamp; NULL if absent or unreadable."""
    return F.try_to_timestamp(text)
