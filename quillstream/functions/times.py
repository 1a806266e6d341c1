"""Time columns: ISO text at rest, timestamps in UTC in flight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def timestamp(c: Column) -> Column:
    """ISO text to a timestamp (no zone: the session's, UTC); null if it isn't one."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def first_time(*columns: Column) -> Column:
    """The first that parses."""
    return F.coalesce(*[timestamp(c) for c in columns])


def minutes_between(later: Column, earlier: Column) -> Column:
    """Whole minutes, 0 at least; null if either is."""
    minutes = F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 60_000_000)
    return F.when(minutes.isNotNull(), F.greatest(F.lit(0).cast("long"), minutes.cast("long")))


def hours(n: float) -> Column:
    return F.expr(f"INTERVAL '{int(n * 3600)}' SECOND")


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")


def retry_at(now: Column, retry_after: Column) -> Column:
    """When to try again: the seconds given (60 at least), or the date (a minute ahead at least), or in 15 minutes."""
    seconds = strip(retry_after).try_cast("int")
    dated = F.try_to_timestamp(F.regexp_replace(strip(retry_after), "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    return (
        F.when(seconds.isNotNull(), F.timestamp_seconds(F.unix_seconds(now) + F.greatest(F.lit(60), seconds)))
        .when(dated.isNotNull(), F.greatest(dated, now + F.expr("INTERVAL '60' SECOND")))
        .otherwise(now + F.expr("INTERVAL '15' MINUTE"))
    )
