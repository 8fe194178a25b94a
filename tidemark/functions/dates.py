"""Date and month helpers as Column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_yyyymmdd(c) -> Column:
    """Lenient parse: accepts ``YYYYMMDD`` or ``YYYY-MM-DD``; invalid -> NULL."""
    s = F.regexp_replace(F.trim(_c(c).cast("string")), "-", "")
    return F.when(F.length(s) == 8, F.try_to_date(s, "yyyyMMdd"))


def parse_yyyymmdd_strict(c) -> Column:
    """Strict parse: an invalid value raises at run time (ANSI)."""
    return F.to_date(F.regexp_replace(_c(c).cast("string"), "-", ""), "yyyyMMdd")


def to_yyyymmdd(c) -> Column:
    return F.date_format(_c(c), "yyyyMMdd")


def month_of(c) -> Column:
    """``YYYYMM`` string of a date/timestamp column."""
    return F.date_format(_c(c), "yyyyMM")


def month_start(month) -> Column:
    """Date of the first day of a ``YYYYMM`` month string (invalid -> NULL)."""
    return F.try_to_date(F.concat(_c(month), F.lit("01")), "yyyyMMdd")


def month_add(month, k: int | Column) -> Column:
    """``YYYYMM`` string ``k`` months after ``month``."""
    kk = k if isinstance(k, Column) else F.lit(k)
    return F.date_format(F.add_months(month_start(month), kk), "yyyyMM")


def as_date(c) -> Column:
    """timestamp / timestamp_ntz / date -> date."""
    return _c(c).cast("date")


def is_weekday(c) -> Column:
    """Monday..Friday (Spark ``weekday``: Monday = 0)."""
    return F.weekday(_c(c)) < 5
