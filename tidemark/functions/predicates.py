"""Optional-conjunct filters: only the arguments that are given become predicates.

Every helper returns a Column (or None) so Catalyst can push the whole
conjunction into the Parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*preds: Column | None) -> Column | None:
    present = [p for p in preds if p is not None]
    if not present:
        return None
    return reduce(lambda a, b: a & b, present)


def where_all(df: DataFrame, *preds: Column | None) -> DataFrame:
    cond = all_of(*preds)
    return df if cond is None else df.where(cond)


def eq(col: str, value) -> Column | None:
    return None if value is None else F.col(col) == F.lit(value)


def in_list(col: str, values) -> Column | None:
    if values is None:
        return None
    if isinstance(values, str):
        values = [values]
    return F.col(col).isin(list(values))


def date_range(col: str, start=None, end=None) -> Column | None:
    from tidemark.functions.dates import parse_yyyymmdd

    lo = None if start is None else F.col(col) >= parse_yyyymmdd(F.lit(str(start)))
    hi = None if end is None else F.col(col) <= parse_yyyymmdd(F.lit(str(end)))
    return all_of(lo, hi)


def contains_like(col: str, text: str | None) -> Column | None:
    """``col LIKE '%text%'`` (case-sensitive; ``%``/``_`` inside text stay wildcards)."""
    if text is None:
        return None
    return F.col(col).like(f"%{text}%")


def any_contains(cols: list[str], text: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).like(f"%{text}%") for c in cols])


def not_blank(col: str) -> Column:
    return F.col(col).isNotNull() & (F.col(col) != F.lit(""))
