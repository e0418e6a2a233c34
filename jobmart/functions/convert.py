"""Conversions that give NULL instead of an error."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(at: dt.datetime) -> Column:
    """A fixed time of day in the session time zone, whatever zone the driver runs in."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp")


def to_int(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("int")


def to_double(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double")


def to_day(text: Column) -> Column:
    """Date from ``yyyy-MM-dd`` or ``yyyy/MM/dd`` text, NULL for blank or bad text.

    Checked by pattern and cast, since a parser given the wrong format raises and discards an
    exception per row.
    """
    shaped = F.when(text.rlike(r"^\d{4}([-/])\d{1,2}\1\d{1,2}$"), F.translate(text, "/", "-"))
    return shaped.try_cast("date")


def compact_day(text: Column, zone: str = "UTC") -> Column:
    """Instant at which the ``yyyyMMdd`` day starts in ``zone``; session time zone is UTC."""
    dashed = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    day = F.when(text.rlike(r"^\d{8}$"), dashed).try_cast("date")
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def epoch_or(seconds: Column, default: Column) -> Column:
    """Timestamp of epoch seconds; NULL and 0 give the default."""
    return F.when(seconds != 0, F.timestamp_seconds(seconds)).otherwise(default)


def batch_id(day: Column, counter: Column) -> Column:
    return F.concat(
        F.date_format(day, "yyyyMMdd"), F.lit("_"), F.lpad(counter.cast("string"), 3, "0")
    )


def ratio(part: Column, whole: Column) -> Column:
    """Exact quotient of two counts, rounded half up to four places."""
    return F.round(
        part.cast("decimal(18,0)") / whole.cast("decimal(18,0)"), 4
    ).cast("decimal(7,4)")
