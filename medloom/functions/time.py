"""Timestamps to fractional days since 1970-01-01 and back, without a time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400
MICROS_PER_DAY = 86_400_000_000


def _epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _epoch(), ts.cast("timestamp_ntz"))


def epoch_days(ts: Column) -> Column:
    """Fractional days since the epoch, microsecond resolution."""
    return epoch_micros(ts).cast("double") / F.lit(float(MICROS_PER_DAY))


def date_from_days(days: Column, rounding: str = "round") -> Column:
    """Whole-second timestamp; ``round`` (half to even) or ``truncate``."""
    seconds = days * F.lit(float(SECONDS_PER_DAY))
    if rounding == "round":
        whole = F.rint(seconds)
    elif rounding == "truncate":
        whole = F.when(seconds < 0, F.ceil(seconds)).otherwise(F.floor(seconds))
    else:
        raise ValueError(f"unknown rounding {rounding!r}")
    return F.timestamp_add("SECOND", whole.cast("bigint"), _epoch())


def days_to_micros(days: float) -> int:
    return round(days * MICROS_PER_DAY)


def parse_timestamp(text: Column, formats: list[str]) -> Column:
    """First format that fits; null for a value that fits none."""
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)
