"""Local days, local weeks and readable durations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmatch.session import LOCAL_ZONE


def instant(moment: datetime | str | Column) -> Column:
    """A UTC instant given as text or datetime."""
    if isinstance(moment, Column):
        return moment
    return F.lit(str(moment)).cast("timestamp")


def local_date(moment: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(moment, zone))


def publication_date(moment: Column, zone: str = LOCAL_ZONE) -> Column:
    """Midnight UTC means the source gave only a day: keep that day."""
    return F.when(F.date_trunc("day", moment) == moment, F.to_date(moment)).otherwise(
        local_date(moment, zone)
    )


def local_week(moment: Column, zone: str = LOCAL_ZONE) -> Column:
    """The Monday that opens the local week of an instant."""
    return F.to_date(F.date_trunc("week", F.from_utc_timestamp(moment, zone)))


def local_midnight(day: Column, zone: str = LOCAL_ZONE) -> Column:
    """The UTC instant at which a local day opens."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def micros_between(earlier: Column, later: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def readable_duration(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.concat(F.format_string("%.0f", seconds), F.lit(" s")))
        .when(seconds < 3600, F.concat(F.format_string("%.1f", seconds / 60), F.lit(" min")))
        .when(seconds < 86400, F.concat(F.format_string("%.1f", seconds / 3600), F.lit(" h")))
        .otherwise(F.concat(F.format_string("%.1f", seconds / 86400), F.lit(" d")))
    )
