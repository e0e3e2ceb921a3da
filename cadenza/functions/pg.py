"""Column helpers that reproduce PostgreSQL semantics with built-in Spark functions.

All helpers return plain Column expressions, so they stay inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pg_concat(*parts) -> Column:
    """PostgreSQL CONCAT: NULL arguments count as empty strings (Spark's concat returns NULL)."""
    return F.concat(*[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])


def dow_sunday0(d) -> Column:
    """EXTRACT(DOW FROM d): Sunday = 0 ... Saturday = 6 (Spark's dayofweek gives Sunday = 1)."""
    return (F.dayofweek(_c(d)) - 1).cast("int")


def month_abbrev(d) -> Column:
    """TO_CHAR(d, 'Mon') -> 'Jan'."""
    return F.date_format(_c(d), "MMM")


def day_abbrev(d) -> Column:
    """TO_CHAR(d, 'Dy') -> 'Mon'."""
    return F.date_format(_c(d), "E")


def plus_months(ts, months) -> Column:
    """ts + (n || ' months')::interval with end-of-month clamping, keeping the time of day.

    ``add_months`` would return a DATE and drop the time, so a year-month interval is added.
    """
    n = months if isinstance(months, Column) else F.lit(int(months))
    return _c(ts) + F.make_ym_interval(F.lit(0), n.cast("int"))


def whole_days(start, end) -> Column:
    """EXTRACT(DAY FROM end - start): whole 24-hour days of the interval, truncated toward zero."""
    return F.extract(F.lit("DAY"), (_c(end) - _c(start))).cast("int")


def as_date(x) -> Column:
    return _c(x).cast("date")


def date_lit(d: _dt.date | str) -> Column:
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


def in_year(d, year: int) -> Column:
    """EXTRACT(YEAR FROM d) = year, written as a half-open range so Parquet gets both bounds."""
    return (_c(d) >= F.lit(_dt.date(year, 1, 1))) & (_c(d) < F.lit(_dt.date(year + 1, 1, 1)))


def in_month(d, as_of: _dt.date) -> Column:
    """Same year and month as ``as_of``, as a half-open date range."""
    first = as_of.replace(day=1)
    nxt = (first.replace(year=first.year + 1, month=1) if first.month == 12
           else first.replace(month=first.month + 1))
    return (_c(d) >= F.lit(first)) & (_c(d) < F.lit(nxt))


def session_date(spark: SparkSession) -> _dt.date:
    """CURRENT_DATE of the session, in its time zone."""
    return spark.range(1).select(F.current_date()).first()[0]


def to_date(value: _dt.date | str | None) -> _dt.date:
    """The date given, or CURRENT_DATE of the active session."""
    if value is None:
        spark = SparkSession.getActiveSession()
        return session_date(spark) if spark else _dt.date.today()
    if isinstance(value, str):
        return _dt.date.fromisoformat(value)
    return value
