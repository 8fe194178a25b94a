"""Totally ordered results with a position column.

A sort in one task (a window without partitions) does not scale, and a hash of the rows cannot see an
order. Rows are range-sorted, written, and numbered by what stands before their partition, so that the
order is part of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import staged


def with_position(df: DataFrame, order_by: Sequence[str | Column], limit: int | None = None, name: str = "position") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the order of ``order_by``; ties by the whole row, so that the
    order is one and the same. ``limit`` keeps the first rows (chosen before the shuffle)."""
    rest = [F.col(c) for c in df.columns]
    if limit is not None:
        rows = df.orderBy(*order_by, *rest).limit(limit)
        w = Window.orderBy(*order_by, *rest)  # at most ``limit`` rows
        return rows.withColumn(name, F.row_number().over(w).cast("bigint"))
    rows = staged(df.orderBy(*order_by, *rest).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))  # a row per partition of the sort
    sizes = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return (rows.withColumn("__part", part).join(F.broadcast(sizes), "__part")
            .select(*df.columns, (F.col("__before") + place + 1).alias(name)))
