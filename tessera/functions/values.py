"""Money, times and business days as column expressions.

A business day runs from 05:00 to 05:00 Chicago time.  Sessions must run in UTC.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import strip

ZONE = "America/Chicago"


def parse_money(x: Column) -> Column:
    """The first word without $ and commas as a number; 0.0 if it isn't one."""
    head = F.get(F.split(strip(F.translate(F.coalesce(x, F.lit("")), "$,", "")), r"\s+"), F.lit(0))
    return F.coalesce(F.when(head.rlike(r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?(nan|inf|infinity)$"), head.try_cast("double")), F.lit(0.0))


def parse_iso(x: Column) -> Column:
    """An instant from an ISO 8601 date (extended or basic) with an optional time; null for anything else.

    Times without a zone are Chicago wall clock.  Calendar dates need day precision; week dates are refused.
    """
    form = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2}):?(\d{2})?:?(\d{2})?([.,]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?$"
    t = F.coalesce(x, F.lit(""))
    part = lambda i, other: F.coalesce(F.nullif(F.regexp_extract(t, form, i), F.lit("")), F.lit(other))
    local = F.concat(part(1, ""), F.lit("-"), part(2, ""), F.lit("-"), part(3, ""), F.lit(" "), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), F.translate(part(7, ""), ",", "."))
    zone = F.nullif(F.regexp_extract(t, form, 8), F.lit(""))
    offset = F.when(zone == "Z", "+00:00").otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.right(zone, F.lit(2))))
    given = F.concat(local, offset).try_cast("timestamp")
    assumed = F.to_utc_timestamp(local.try_cast("timestamp_ntz").cast("timestamp"), ZONE)
    # an offset without a time isn't a date and time
    ok = t.rlike(form) & ~(zone.isNotNull() & (F.regexp_extract(t, form, 4) == ""))
    return F.when(F.coalesce(ok, F.lit(True)) & t.rlike(form), F.when(zone.isNotNull(), given).otherwise(assumed))


def business_day(ts: Column) -> Column:
    """Date of the business day that an instant falls in."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), ZONE) - F.expr("interval 5 hours"))


def business_day_start(day: Column) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp") + F.expr("interval 5 hours"), ZONE)


def business_range(first: date | str, last: date | str) -> tuple[Column, Column]:
    """Start of the first and end of the last business day."""
    a, b = F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date")
    return business_day_start(a), business_day_start(F.date_add(b, 1))


def relabel_as_chicago(ts: Column) -> Column:
    """An instant whose wall clock was Chicago's but was labelled UTC."""
    return F.to_utc_timestamp(ts, ZONE)


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 6e7


def drift_seconds(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / 1e6


def duration_words(minutes: Column) -> Column:
    """45m, 4h or 2.5h."""
    hours = F.round(minutes / 60, 1)
    whole = hours == F.floor(hours)
    return F.when(minutes < 60, F.concat(F.round(minutes).cast("int"), F.lit("m"))).when(whole, F.concat(hours.cast("int"), F.lit("h"))).otherwise(F.concat(hours.cast("string"), F.lit("h")))


def ago_words(ts: Column, as_of: Column) -> Column:
    minutes = F.floor(minutes_between(as_of, ts))
    return (
        F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
    )
