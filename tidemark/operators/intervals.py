"""Joins of points with closed date ranges, by calendar bins instead of a range condition.

A range is cut into the bins that it touches and a point lies in one bin, so the join is an equi-join on
(keys, bin) followed by the exact test: a key with many points and many ranges spreads over its bins, and
a point meets only ranges of its own bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days per bin: about the length of the ranges that are planned; a longer range is in several bins.
BIN_DAYS = 32


def _bin(day, width: int):
    return F.floor(F.unix_date(day) / F.lit(width)).cast("int")


def interval_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], point: str, start: str, end: str,
                  how: str = "inner", width: int = BIN_DAYS) -> DataFrame:
    """Points of ``points`` with the rows of ``ranges`` that have the same keys and ``start <= point <= end``.

    inner: one row per (point, range), the columns of both; left_semi and left_anti: points with and
    without a range, once each. A NULL key, point or bound matches nothing, an empty range neither.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join {how!r}")
    keys = list(keys)
    lo, hi = F.col(start).cast("date"), F.col(end).cast("date")
    cut = ranges.withColumn("__bin", F.explode(F.when(lo <= hi, F.sequence(_bin(lo, width), _bin(hi, width)))))
    # the range columns get names of their own, so that points may use the same ones
    cut = cut.select(*[F.col(c).alias(f"__r_{c}") for c in cut.columns])
    placed = points.withColumn("__bin", _bin(F.col(point).cast("date"), width))
    on = F.col("__bin") == F.col("__r___bin")
    for k in keys:
        on = on & (placed[k] == F.col(f"__r_{k}"))
    hit = on & F.col(point).cast("date").between(F.col(f"__r_{start}").cast("date"), F.col(f"__r_{end}").cast("date"))
    out = placed.join(cut, hit, how).drop("__bin")
    if how != "inner":
        return out
    extra = [c for c in ranges.columns if c not in keys]
    return out.select(*points.columns, *[F.col(f"__r_{c}").alias(c) for c in extra])
