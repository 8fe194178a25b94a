"""Calendar operators: trading days, coverage, missing dates, backfill plans.

The source application loops over symbols (three queries each) and compares
Python sets. Here all symbols are handled by one plan:

* a symbol's dates are one bit mask per month, built by a partial ``bit_or``, so
  repeated rows and a hot symbol cost nothing after the first aggregate;
* the open days of the calendar are masks too, one array that is a scalar of the
  plan (12 numbers a year); expected days come from its running count, missing
  days from ``calendar AND NOT present``, without joining or expanding days.

A calendar holds one row per day per exchange, so its size is bounded by the
calendar span (about 3.6k rows per decade), not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import where_all, date_range


def trading_days(cal: DataFrame, exchange: str | None = None, start=None, end=None,
                 is_open: bool | None = True) -> DataFrame:
    """Calendar rows of one exchange (or all), optional date range, open/closed/all."""
    out = where_all(cal,
                    None if exchange is None else F.col("exchange") == exchange,
                    date_range("cal_date", start, end),
                    None if is_open is None else F.col("is_open") == F.lit(is_open))
    return out


def open_days(cal: DataFrame, exchange: str | None = None) -> DataFrame:
    """Distinct open dates (of one exchange, or of the given single-exchange calendar)."""
    c = cal if exchange is None else cal.where(F.col("exchange") == exchange)
    return c.where("is_open").select(F.col("cal_date")).distinct()


def every_day_calendar(dates: DataFrame, col: str, exchange: str = "ALL") -> DataFrame:
    """Calendar with every day open between the min and max of ``dates[col]``."""
    span = dates.select(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("span")).scalar()
    one = dates.sparkSession.range(1).select(F.lit(exchange).alias("exchange"))
    return one.select("exchange", F.explode(F.sequence(span["lo"], span["hi"])).alias("cal_date"),
                      F.lit(True).alias("is_open"))


def _month_number(day):
    return F.year(day) * 12 + F.month(day) - 1


def _bit(day):
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.dayofmonth(day))


def _up_to(day):
    """Mask of the days of a month up to ``day``, itself included."""
    return _bit(day) * 2 - 1


def month_masks(dates: DataFrame, key: str | None, date_col: str) -> DataFrame:
    """(key, month number, mask of days, first and last day, rows) by a partial aggregate."""
    day = F.col(date_col).cast("date")
    by = ([F.col(key)] if key else []) + [_month_number(day).alias("m")]
    return dates.groupBy(*by).agg(F.bit_or(_bit(day)).alias("mask"), F.min(day).alias("lo"), F.max(day).alias("hi"), F.count("*").alias("rows"))


def calendar_masks(calendar: DataFrame):
    """Scalar of the plan: first month number of the open days, the mask of every month since, and the
    number of open days before each; NULL for a calendar without open days."""
    months = month_masks(calendar.where("is_open AND cal_date IS NOT NULL").select("cal_date"), None, "cal_date")
    one = months.agg(F.min("m").alias("first"), F.max("m").alias("last"), F.map_from_entries(F.collect_list(F.struct("m", "mask"))).alias("by"))
    one = one.where("first IS NOT NULL").select("first", F.transform(F.sequence("first", "last"), lambda m: F.coalesce(F.col("by")[m], F.lit(0).cast("bigint"))).alias("masks"))
    start = F.array(F.lit(0).cast("bigint"))
    before = F.aggregate("masks", start, lambda acc, mask: F.concat(acc, F.array(F.element_at(acc, -1) + F.bit_count(mask))))
    return one.select(F.struct("first", "masks", before.alias("before")).alias("cal")).scalar()


def _open_before(cal, day, include: bool):
    """Open days before ``day`` (or up to it)."""
    at = F.greatest(F.lit(0), F.least(_month_number(day) - cal["first"], F.size(cal["masks"])))
    inside = (_month_number(day) >= cal["first"]) & (_month_number(day) < cal["first"] + F.size(cal["masks"]))
    clip = _up_to(day) if include else _bit(day) - 1
    part = F.when(inside, F.bit_count(F.get(cal["masks"], at).bitwiseAND(clip))).otherwise(0)
    return F.get(cal["before"], at) + part


def coverage_report(series: DataFrame, key: str, date_col: str, calendar: DataFrame | None = None,
                    codes: DataFrame | None = None) -> DataFrame:
    """Per symbol: min/max date, actual, expected (open calendar days in [min, max]),
    missing = max(expected - actual, 0), coverage_pct = round(actual/expected*100, 2).

    Without a calendar, expected = actual. Symbols listed in ``codes`` but absent
    from the series get a zero row.
    """
    b = month_masks(series, key, date_col).groupBy(key).agg(
        F.min("lo").alias("min_date"), F.max("hi").alias("max_date"),
        F.coalesce(F.sum(F.bit_count("mask")), F.lit(0)).cast("bigint").alias("actual"))
    if calendar is not None:
        cal = calendar_masks(calendar)
        expected = F.when(F.col("min_date").isNotNull(), F.coalesce(
            _open_before(cal, F.col("max_date"), True) - _open_before(cal, F.col("min_date"), False), F.lit(0)))
    else:
        expected = F.col("actual")
    rep = b.select(key, "min_date", "max_date", "actual", expected.cast("bigint").alias("expected"))
    rep = rep.select("*", F.greatest(F.col("expected") - F.col("actual"), F.lit(0)).cast("bigint").alias("missing"),
                     F.when(F.col("expected") > 0, F.round(F.col("actual") / F.col("expected") * 100.0, 2))
                     .otherwise(F.lit(0.0)).alias("coverage_pct"))
    if codes is not None:
        rep = codes.select(key).distinct().join(rep, key, "left").select(
            key, "min_date", "max_date",
            *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("actual", "expected", "missing")],
            F.coalesce("coverage_pct", F.lit(0.0)).alias("coverage_pct"))
    return rep


def missing_dates(series: DataFrame, key: str, date_col: str, calendar: DataFrame) -> DataFrame:
    """(key, missing_date) for every open calendar day inside a symbol's own
    [min, max] that has no row.

    The window runs over the months of a symbol, which the calendar bounds; each month stands for
    itself and the empty months up to the next one.
    """
    cal = calendar_masks(calendar)
    months = month_masks(series.where(F.col(key).isNotNull() & F.col(date_col).isNotNull()), key, date_col)
    w, whole = Window.partitionBy(key).orderBy("m"), Window.partitionBy(key)
    months = months.select(key, "m", "mask", F.min("lo").over(whole).alias("lo"), F.max("hi").over(whole).alias("hi"),
                           (F.coalesce(F.lead("m").over(w), F.col("m") + 1) - 1).alias("until"))
    each = months.select(key, "lo", "hi", "m", "mask", F.explode(F.sequence("m", "until")).alias("month"))
    left = F.coalesce(F.get(cal["masks"], F.when(F.col("month") >= cal["first"], F.col("month") - cal["first"])), F.lit(0).cast("bigint"))
    left = F.when(F.col("month") == F.col("m"), left.bitwiseAND(F.bitwise_not("mask"))).otherwise(left)
    left = F.when(F.col("month") == _month_number(F.col("lo")), left.bitwiseAND(F.bitwise_not(_up_to(F.col("lo"))))).otherwise(left)
    left = F.when(F.col("month") == _month_number(F.col("hi")), left.bitwiseAND(_up_to(F.col("hi")))).otherwise(left)
    days = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda d: F.call_function("shiftright", F.col("left"), d).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    first = F.make_date(F.floor(F.col("month") / 12).cast("int"), (F.col("month") % 12 + 1).cast("int"), F.lit(1))
    return (each.select(key, "month", left.alias("left")).where("left <> 0")
            .select(key, first.alias("first"), F.explode(days).alias("d")).select(key, F.date_add("first", F.col("d") - 1).alias("missing_date")))


def backfill_plan(missing: DataFrame, key: str, date_col: str = "missing_date", chunk: int = 30) -> DataFrame:
    """Missing dates -> (key, chunk, start, end, n_dates), ``chunk`` dates per request.

    The window is per symbol over its missing days, bounded by the calendar.
    """
    w = Window.partitionBy(key).orderBy(date_col)
    c = missing.select(key, date_col, F.floor((F.row_number().over(w) - 1) / chunk).cast("bigint").alias("chunk"))
    return c.groupBy(key, "chunk").agg(F.min(date_col).alias("start_date"), F.max(date_col).alias("end_date"),
                                       F.count(F.lit(1)).alias("n_dates"))


def period_plan(ranges: DataFrame, threshold: int = 60, keys=("range_id",)) -> DataFrame:
    """Split each ``[start_date, end_date]`` range into load periods: one per day if it
    spans at most ``threshold`` days, else one per calendar quarter clipped to the
    range. A range whose start is after its end yields nothing."""
    keys = list(keys)
    span = F.datediff("end_date", "start_date")
    ok = F.col("start_date") <= F.col("end_date")
    by_day = F.when(ok & (span <= threshold), F.sequence("start_date", "end_date"))
    q0 = F.trunc("start_date", "quarter")
    by_q = F.when(ok & (span > threshold), F.sequence(q0, "end_date", F.expr("INTERVAL 3 MONTHS")))
    days = ranges.select(*keys, F.explode(by_day).alias("d")).select(
        *keys, F.col("d").alias("period_start"), F.col("d").alias("period_end"), F.lit("day").alias("mode"))
    quarters = ranges.select(*keys, "start_date", "end_date", F.explode(by_q).alias("q")).select(
        *keys, F.greatest("q", "start_date").alias("period_start"),
        F.least(F.date_sub(F.add_months("q", 3), 1), "end_date").alias("period_end"),
        F.lit("quarter").alias("mode"))
    return days.unionByName(quarters)


def month_plan(ranges: DataFrame, keys=("range_id",)) -> DataFrame:
    """Every month touched by ``[start_date, end_date]``: ``YYYYMM``, month start, month end."""
    keys = list(keys)
    lo, hi = F.trunc("start_date", "month"), F.trunc("end_date", "month")
    m = ranges.select(*keys, F.explode(F.when(lo <= hi, F.sequence(lo, hi, F.expr("INTERVAL 1 MONTH"))))
                      .alias("ms"))
    return m.select(*keys, F.date_format("ms", "yyyyMM").alias("month"), F.col("ms").alias("month_start"),
                    F.last_day("ms").alias("month_end"))
