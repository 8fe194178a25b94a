"""As-of lookups without per-row queries.

Two forms:

``asof_join``
    General forward / backward as-of between a request table and a time
    series keyed the same way: a merge on range partitions. Spark has no as-of
    join, and a plain ``union + window partitioned by key`` would put a whole
    key's history into one task.

    1. requests and series rows are unioned and range-partitioned on
       ``(key, time)``; a key with many rows spreads over as many partitions as
       its rows need, even requests of one key and instant do;
    2. each partition is scanned with a running window per key;
    3. what a partition's neighbours hold is carried over its boundary: the first
       (last) series row of every (partition, key), one partial aggregate, filled
       over the partitions of the key.

    The result is ``coalesce(within the partition, carried)``.

``month_closes``
    The special case used by every recommendation query: the first close on or
    after a month start and the last close before ``month start + k months``.
    Both reduce to per-(symbol, month) first/last bars (a partial aggregate),
    then a forward/backward fill over months per symbol.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import month_start
from tidemark.session import staged


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
              values: Sequence[str], direction: str = "forward", inclusive: bool = True,
              prefix: str = "") -> DataFrame:
    """Attach to each ``left`` row the matching ``right`` row's time and values.

    forward:  first right row with ``right_time >= left_time`` (``>`` if not inclusive)
    backward: last right row with ``right_time <= left_time`` (``<`` if not inclusive)
    Left rows without a match keep NULLs (left-join semantics). Output columns:
    all of ``left`` plus ``{prefix}{right_time}`` and ``{prefix}{v}`` for each value (a name that
    ``left`` has already raises). A NULL key or time matches nothing. Of several right rows of one key
    and time the smallest ``(right_time, *values)`` is taken forward and the greatest backward.
    """
    if direction not in ("forward", "backward"):
        raise ValueError("direction must be 'forward' or 'backward'")
    keys = list(keys)
    fwd = direction == "forward"
    payload_fields = [right_time, *values]
    lcols = left.columns
    clash = {f"{prefix}{f}" for f in payload_fields} & set(lcols)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already: choose a prefix")
    valid = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, left_time)])
    right = right.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, right_time)]))

    # tag decides the order of a request and a series row at the same instant:
    # forward+inclusive and backward+strict need the request first.
    req_first = (fwd and inclusive) or (not fwd and not inclusive)
    req_tag, row_tag = (0, 1) if req_first else (1, 0)

    kcols = [f"__k{i}" for i in range(len(keys))]
    payload = F.struct(*[F.col(f) for f in payload_fields])
    req = left.select(*[F.col(c) for c in lcols], F.lit(True).alias("__rid"), *[F.col(k).alias(n) for k, n in zip(keys, kcols, strict=True)],
                      F.col(left_time).alias("__t"), F.lit(req_tag).alias("__tag"),
                      F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("__p"))
    rows = right.select(*[F.col(k).alias(n) for k, n in zip(keys, kcols, strict=True)], F.col(right_time).alias("__t"),
                        F.lit(row_tag).alias("__tag"), payload.alias("__p"))
    # the order of the partitions is that of the scan; the last column parts requests of one key and instant
    order = [*kcols, "__t", "__tag", "__p"]
    merged = (req.unionByName(rows, allowMissingColumns=True)
              .withColumn("__salt", F.when(F.col("__rid"), F.xxhash64(F.monotonically_increasing_id())))
              .repartitionByRange(*order, "__salt").withColumn("__part", F.spark_partition_id()).drop("__salt"))
    merged = staged(merged, "asof")  # partition numbers are what was written, whatever is computed again later

    # a running frame in the direction of the search: what was seen last is the nearest match
    turn = (lambda c: F.col(c).desc()) if fwd else F.col
    w = Window.partitionBy("__part", *kcols).orderBy(*[turn(c) for c in ("__t", "__tag", "__p")])
    found = F.last("__p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = merged.select("*", found.alias("__m")).where(F.col("__rid").isNotNull())

    # one row per (partition, key): what it holds for its neighbours, and whether it asks
    pick = F.min if fwd else F.max
    edge = merged.groupBy("__part", *kcols).agg(pick("__p").alias("__edge"), F.max("__rid").alias("__asks"))
    wp = Window.partitionBy(*kcols).orderBy(turn("__part"))
    carried = F.last("__edge", ignorenulls=True).over(wp.rowsBetween(Window.unboundedPreceding, -1))
    carry = edge.select("__part", *[F.col(k).alias(f"{k}c") for k in kcols], carried.alias("__f"), "__asks").where("__asks AND __f IS NOT NULL")
    carry = carry.withColumnRenamed("__part", "__partc").drop("__asks")
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{k}c") for k in kcols], F.col("__part") == F.col("__partc"))
    joined = within.join(carry, on, "left")
    match = F.when(valid, F.coalesce(F.col("__m"), F.col("__f")))
    return joined.select(*[F.col(c) for c in lcols],
                         *[match[f].alias(f"{prefix}{f}") for f in payload_fields])


def monthly_edges(bars: DataFrame, price: str = "close") -> DataFrame:
    """One row per (symbol, month): first and last bar of the month (partial aggregate)."""
    return (bars.groupBy("ts_code", F.trunc("trade_date", "month").alias("m"))
            .agg(F.min_by(price, "trade_date").alias("__first"),
                 F.min("trade_date").alias("__first_date"),
                 F.max_by(price, "trade_date").alias("__last"),
                 F.max("trade_date").alias("__last_date")))


def month_closes(bars: DataFrame, requests: DataFrame, horizons: Sequence[int] = (1,),
                 price: str = "close") -> DataFrame:
    """For each distinct (ts_code, month) request:

    ``first_date``/``first_close``: first bar on or after the month start (no upper bound);
    ``last_close_{k}``: last bar strictly before ``month start + k months`` (no lower bound).

    A suspended symbol therefore borrows bars from other months, as in the
    source application. The bar itself decides, whatever its price: a NULL price is returned as
    such on either side. Rows whose symbol has no bar at all get NULLs.
    Plan: one partial aggregate to month grain, one shuffle by symbol for the
    fill; the per-symbol window holds one row per month on the calendar plus
    the requests, independent of how many bars a symbol has.
    """
    req = requests.select("ts_code", "month").distinct().withColumn("m", month_start(F.col("month")))
    edges = monthly_edges(bars, price)
    # spine rows from one pass over the requests: k = 0 asks for the forward value at m,
    # k > 0 for the backward value at m + k - 1
    ks = F.explode(F.array(*[F.lit(k) for k in (0, *horizons)])).alias("k")
    spine = req.select("ts_code", "month", "m", ks).select(
        "ts_code", "month", F.when(F.col("k") == 0, F.col("m")).otherwise(F.add_months("m", F.col("k") - 1))
        .alias("m"), "k",
        F.lit(None).cast("double").alias("__first"), F.lit(None).cast("date").alias("__first_date"),
        F.lit(None).cast("double").alias("__last"), F.lit(None).cast("date").alias("__last_date"))
    allrows = edges.withColumn("month", F.lit(None).cast("string")).withColumn("k", F.lit(None).cast("int")) \
        .unionByName(spine)
    w = Window.partitionBy("ts_code").orderBy("m")
    fwd = w.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    bwd = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    filled = allrows.select(
        "ts_code", "month", "k",
        F.first(F.when(F.col("__first_date").isNotNull(),
                       F.struct(F.col("__first_date").alias("d"), F.col("__first").alias("p"))),
                ignorenulls=True).over(fwd).alias("__fwd"),
        F.last(F.when(F.col("__last_date").isNotNull(), F.struct(F.col("__last").alias("p"))),
               ignorenulls=True).over(bwd)["p"].alias("__bwd"),
    ).where(F.col("k").isNotNull())
    aggs = [F.max(F.when(F.col("k") == 0, F.col("__fwd.d"))).alias("first_date"),
            F.max(F.when(F.col("k") == 0, F.col("__fwd.p"))).alias("first_close")]
    for k in horizons:
        aggs.append(F.max(F.when(F.col("k") == k, F.col("__bwd"))).alias(f"last_close_{k}"))
    return filled.groupBy("ts_code", "month").agg(*aggs)
