"""Civil times and zones as columns: UTC, fixed EST and EDT, US Eastern with its daylight rules, or an offset in hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = {"utc": 0, "est": -5, "edt": -4}


def eastern_dst(local: Column) -> Column:
    """Whether a civil time lies from 02:00 of the second Sunday of March to 02:00 of the first Sunday of November."""
    year = F.year(local)
    first = lambda month: F.make_date(year, F.lit(month), F.lit(1))
    sunday = lambda d: F.date_add(d, F.pmod(F.lit(8) - F.dayofweek(d), F.lit(7)))
    at = lambda d: F.expr("interval 2 hours") + d.cast("timestamp_ntz")
    return (local >= at(F.date_add(sunday(first(3)), 7))) & (local < at(sunday(first(11))))


def offset_hours(local: Column, zone: str | int) -> Column:
    """Hours east of UTC at a civil time."""
    if isinstance(zone, int):
        return F.lit(zone)
    name = zone.strip().lower()
    if name in ("us/eastern", "america/new_york", "us_eastern"):
        return F.when(eastern_dst(local), -4).otherwise(-5)
    if name in NAMES:
        return F.lit(NAMES[name])
    return F.lit(int(name))


def local_to_unix(local: Column, zone: str | int) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    return F.unix_seconds(F.convert_timezone(F.lit("UTC"), F.current_timezone(), local).cast("timestamp")) - offset_hours(local, zone) * 3600


def unix_to_local(seconds: Column, zone: str | int) -> Column:
    """The civil time; within the hour that is there twice the daylight one."""
    base = lambda hours: F.timestamp_seconds(seconds + hours * 3600).cast("timestamp_ntz")
    if isinstance(zone, int) or zone.strip().lower() not in ("us/eastern", "america/new_york", "us_eastern"):
        return base(offset_hours(F.lit(None), zone))
    return F.when(eastern_dst(base(F.lit(-4))), base(F.lit(-4))).otherwise(base(F.lit(-5)))
