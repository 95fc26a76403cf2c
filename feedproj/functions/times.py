"""Timestamp expressions. The session time zone must be UTC (``session.use_utc``)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedproj.schema import ISO_DATE, SQL_DATE, ZERO_DATE


def instant(value: str | dt.datetime | Column) -> Column:
    """``as_of`` arguments: text or datetime as a UTC timestamp literal."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp")


def is_unset(col: Column) -> Column:
    """Null, empty and zero dates all mean "no date given"."""
    return col.isNull() | col.isin("", ZERO_DATE)


def _shaped(col: Column, shape: str) -> Column:
    # The pattern fixes the format, the cast checks the calendar: a cast neither
    # throws on bad text nor builds a formatter, unlike parsing with a format.
    return F.when(col.rlike(shape), col.try_cast("timestamp"))


def _sql_date(col: Column) -> Column:
    return _shaped(col, SQL_DATE)


def _iso_date(col: Column) -> Column:
    return _shaped(col, ISO_DATE)


def date_is_acceptable(col: Column) -> Column:
    """Unset, or readable in one of the two accepted formats."""
    return is_unset(col) | F.coalesce(_sql_date(col), _iso_date(col)).isNotNull()


def parse_gmt(col: Column, as_of: str | dt.datetime | Column) -> Column:
    """Source date text to an instant; unset becomes ``as_of``, unreadable NULL."""
    zoned = col.contains("+") | col.endswith("Z")
    return F.when(is_unset(col), instant(as_of)).otherwise(
        F.when(zoned, _iso_date(col)).otherwise(_sql_date(col))
    )


def atom(col: Column) -> Column:
    """ISO-8601 with numeric offset, as used inside checksums."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ssxxx")


def iso_utc(col: Column) -> Column:
    """ISO-8601 text of a timestamp or timestamp text; unreadable or NULL gives NULL."""
    return atom(col.try_cast("timestamp"))
