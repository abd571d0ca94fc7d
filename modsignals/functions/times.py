"""Time columns: P11, P12, P20 and the run stamp."""

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_MICROS = 86_400_000_000


def as_timestamp(value: "Column | datetime | str | None") -> Column:
    """P20: an explicit run time when given (repeatable), else the current time."""
    if value is None:
        return F.current_timestamp()
    if isinstance(value, Column):
        return value.cast("timestamp")
    return F.lit(value).cast("timestamp")


def from_epoch(seconds: Column) -> Column:
    """Seconds with fraction, rounded to whole microseconds (a plain conversion would cut them off)."""
    return F.timestamp_micros(F.rint(seconds * F.lit(1_000_000.0)).cast("bigint"))


def _micros_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))


def age_days(now: Column, created: Column) -> Column:
    """Whole days, rounded down also for negative ages, in integer arithmetic."""
    gap = _micros_between(now, created)
    whole = gap - F.pmod(gap, F.lit(_DAY_MICROS))
    return (whole / F.lit(_DAY_MICROS)).cast("bigint")


def age_seconds(now: Column, created: Column) -> Column:
    """Seconds with fraction."""
    return _micros_between(now, created) / F.lit(1_000_000.0)


def run_id(run_ts: Column) -> Column:
    """Run stamp with seconds, so two runs in a minute stay apart."""
    return F.date_format(run_ts, "yyyyMMdd_HHmmss")
