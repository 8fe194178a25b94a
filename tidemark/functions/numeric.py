"""Numeric helpers: safe division, percent change, NaN handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct_change(first, last) -> Column:
    """``(last - first) / first * 100``; NULL when first is 0 or NULL (never inf, never raises)."""
    f, l_ = _c(first), _c(last)
    return F.try_divide(l_ - f, F.nullif(f, F.lit(0.0))) * F.lit(100.0)


def nan_to_null(c) -> Column:
    x = _c(c)
    return F.when(~F.isnan(x), x)


def safe_ratio_pct(num, den, digits: int = 1) -> Column:
    return F.round(F.try_divide(_c(num).cast("double"), F.nullif(_c(den).cast("double"), F.lit(0.0))) * 100.0, digits)

