"""Civil days in a fixed zone, clamps and timestamp forms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours that the civil day is ahead of UTC. The zone has no summer time, so a shift is exact.
AHEAD = 9


def civil_day(ts: Column, ahead: int = AHEAD) -> Column:
    """Date of a UTC timestamp (with or without zone) in the civil zone; null stays null."""
    return F.to_date(ts + F.expr(f"INTERVAL {ahead} HOURS"))


def on_civil_day(ts: Column, day: dt.date, ahead: int = AHEAD) -> Column:
    """Whether ts falls on the civil day, as a range of ts, which reaches the scan as a filter."""
    start = dt.datetime.combine(day, dt.time()) - dt.timedelta(hours=ahead)
    at = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    return (ts >= at(start)) & (ts < at(start + dt.timedelta(days=1)))


def day_end(day: Column, ahead: int = AHEAD) -> Column:
    """UTC instant at which a civil day ends, without zone."""
    return day.cast("timestamp_ntz") + F.expr(f"INTERVAL {24 - ahead} HOURS")


def until(updated: Column, day: Column, ahead: int = AHEAD) -> Column:
    """Up to when a day's aggregate holds: its last update, at most the day's end."""
    return F.least(updated, day_end(day, ahead))


def month_key(ts: Column, ahead: int = AHEAD) -> Column:
    """yyyy-MM of the civil month."""
    return F.date_format(ts + F.expr(f"INTERVAL {ahead} HOURS"), "yyyy-MM")


def parse_rfc1123(text: Column) -> Column:
    """Timestamp of 'Sat, 21 Nov 2026 18:04:45 GMT'; null where it is none. The weekday is not looked at."""
    return F.try_to_timestamp(F.substring(text, 6, 100), F.lit("dd MMM yyyy HH:mm:ss z"))
