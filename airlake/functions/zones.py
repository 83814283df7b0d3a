"""Days by an explicit time zone. Clock times are ``timestamp_ntz`` throughout,
so nothing here depends on the session's time zone.

``zone`` is a name such as ``Asia/Kolkata`` or a column of names (one zone per
station); an unknown name fails the job, a NULL one gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "1970-01-01 00:00:00"


def _zone(zone: str | Column) -> Column:
    return F.lit(zone) if isinstance(zone, str) else zone


def utc_clock(text: Column) -> Column:
    """ISO text of an instant -> the clock time in UTC. An offset is honoured
    (``Z``, ``+05:30``), text without one is UTC already; bad text is NULL."""
    micros = F.unix_micros(text.try_cast("timestamp"))
    since = F.make_dt_interval(secs=micros.cast("decimal(20,0)") / F.lit(1000000))
    instant = F.lit(_EPOCH).cast("timestamp_ntz") + since
    return F.when(F.rlike(text, F.lit(r":.*([Zz]|[+-][0-9]{2}:?[0-9]{2})$")), instant).otherwise(
        text.try_cast("timestamp_ntz"))


def local_clock(utc: Column, zone: str | Column) -> Column:
    """Clock time in UTC -> clock time in ``zone``."""
    return F.convert_timezone(F.lit("UTC"), _zone(zone), utc)


def utc_of_local(local: Column, zone: str | Column) -> Column:
    """Clock time in ``zone`` -> clock time in UTC. A time that the clocks
    skip moves on by the skipped hour; one that they repeat is its first."""
    return F.convert_timezone(_zone(zone), F.lit("UTC"), local)


def local_day(utc: Column, zone: str | Column) -> Column:
    return F.to_date(local_clock(utc, zone))


def day_hours(date: Column, zone: str | Column) -> Column:
    """Length of the local day in hours: 24, or 23 or 25 where clocks change."""
    midnight = lambda d: utc_of_local(d.cast("timestamp_ntz"), zone)
    return F.timestamp_diff("MINUTE", midnight(date), midnight(F.date_add(date, 1))) / F.lit(60.0)
