"""Time expressions that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.fixed.auth import MONTHS


def epoch(ts: Column) -> Column:
    """Seconds since 1970 as a double, microseconds kept."""
    return F.unix_micros(ts) / F.lit(1e6)


def as_utc(ts: Column) -> Column:
    """A zone-less timestamp read as UTC, whatever the session zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts))


def month_number(name: Column) -> Column:
    """1..12 for 'Jan'..'Dec', NULL for anything else."""
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name), F.lit(0)).cast("int")


def syslog_time(month: Column, day: Column, clock: Column, year: int, zone: str = "UTC") -> Column:
    """'Feb', '27', '14:32:01' in the given year; NULL when there is no such moment."""
    hms = F.split(clock, ":")
    return F.try_make_timestamp(
        F.lit(year), month_number(month), day.try_cast("int"),
        F.get(hms, F.lit(0)).try_cast("int"), F.get(hms, F.lit(1)).try_cast("int"),
        F.get(hms, F.lit(2)).try_cast("decimal(16,6)"), F.lit(zone),
    )


def iso_time(text: Column, zone: str = "UTC") -> Column:
    """ISO-8601 with 'Z', '+hh:mm' or '+hhmm'; text without an offset is read in `zone`."""
    colon = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(colon.rlike(r"(Z|[+-]\d{2}:\d{2})$"), colon).otherwise(F.concat(colon, F.lit(f"[{zone}]")))
    return zoned.try_cast("timestamp")


def age_seconds(ts: Column, now: Column) -> Column:
    return F.floor((F.unix_micros(now) - F.unix_micros(ts)) / F.lit(1e6)).cast("long")
