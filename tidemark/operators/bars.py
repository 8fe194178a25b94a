"""Bar operators: price adjustment, moving averages, resampling, indicator table.

All windows are partitioned by symbol and ordered by date; a symbol has at
most one bar per calendar day, so one window partition is bounded by the
calendar length (about 250 rows per year), whatever the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.schemas import FACTOR_COLS

PRICE_COLS = ("open", "high", "low", "close")


def moving_mean(c: str, w, n: int):
    """Mean of the last ``n`` values: their sum in date order divided by ``n``, in doubles, not rounded;
    NULL until ``n`` values other than NULL stand in the frame."""
    frame = w.rowsBetween(-(n - 1), Window.currentRow)
    return F.when(F.count(c).over(frame) == n, F.avg(F.col(c).cast("double")).over(frame))


def latest_factor(factors: DataFrame) -> DataFrame:
    """Per symbol, ``coalesce(max(adj_factor), 1)`` over its whole history (the
    largest factor, not the newest-dated one)."""
    return factors.groupBy("ts_code").agg(F.coalesce(F.max("adj_factor"), F.lit(1.0)).alias("__latest"))


def adjust(bars: DataFrame, factors: DataFrame, mode: str | None = "qfq") -> DataFrame:
    """Adjusted OHLC for all symbols at once.

    qfq: ``p * coalesce(f, 1) / latest``;  hfq: ``p / coalesce(nullif(f, 0), 1) * latest``;
    None: unadjusted. A bar without a factor row uses 1; a symbol without any
    factor uses ``latest = 1``.
    """
    if mode is None:
        return bars
    if mode not in ("qfq", "hfq"):
        raise ValueError("mode must be 'qfq', 'hfq' or None")
    f = factors.select("ts_code", "trade_date", "adj_factor")
    j = (bars.join(f, ["ts_code", "trade_date"], "left")
         .join(latest_factor(f), "ts_code", "left"))
    latest = F.coalesce(F.col("__latest"), F.lit(1.0))
    fac = F.col("adj_factor")
    out = []
    for c in bars.columns:
        if c in PRICE_COLS:
            if mode == "qfq":
                e = F.col(c) * F.coalesce(fac, F.lit(1.0)) / latest
            else:
                e = F.col(c) / F.coalesce(F.nullif(fac, F.lit(0.0)), F.lit(1.0)) * latest
            out.append(e.alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def kline_records(adjusted: DataFrame) -> DataFrame:
    """Chart-ready column names: ``trade_date -> time``, ``vol -> volume``."""
    return adjusted.select("ts_code", F.col("trade_date").alias("time"), "open", "high", "low", "close",
                           F.col("vol").alias("volume"), "amount")


def moving_avg(bars: DataFrame, periods: Sequence[int] = (5, 10, 20, 60), price: str = "close") -> DataFrame:
    """Simple moving averages; NULL until the window holds ``n`` bars."""
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    return bars.select("ts_code", "trade_date", price, *[moving_mean(price, w, n).alias(f"ma{n}") for n in periods])


def resample(bars: DataFrame, unit: str = "week") -> DataFrame:
    """Daily bars -> week / month bars. The bar is dated by its last trading day."""
    if unit not in ("week", "month"):
        raise ValueError("unit must be 'week' or 'month'")
    period = F.date_trunc(unit, "trade_date")
    return (bars.groupBy("ts_code", period.alias("__p"))
            .agg(F.max("trade_date").alias("trade_date"),
                 F.min_by("open", "trade_date").alias("open"),
                 F.max("high").alias("high"),
                 F.min("low").alias("low"),
                 F.max_by("close", "trade_date").alias("close"),
                 F.sum("vol").alias("vol"),
                 F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))
            .drop("__p"))


def bar_flags(bars: DataFrame, basic: DataFrame) -> DataFrame:
    """Up/down flag (``close >= open``) and market value in units of 1e8."""
    b = basic.select("ts_code", "trade_date", "total_mv")
    return (bars.join(b, ["ts_code", "trade_date"], "left")
            .select("ts_code", "trade_date", (F.col("close") >= F.col("open")).alias("is_up"),
                    (F.col("total_mv") / 1e8).alias("total_mv_e8")))


def factor_table(bars: DataFrame, digits: int = 4, keep: Sequence[str] = ()) -> DataFrame:
    """A wide indicator table computed from bars with running windows (the stored
    indicator table of the source is vendor-computed; this one only needs to be
    wide and deterministic, so projections of a column subset can be tested), after
    the columns ``keep`` of the bars."""
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    means = [("close", 5), ("close", 10), ("close", 20), ("close", 60), ("open", 5), ("high", 5), ("vol", 5)]
    bars = bars.select("*", *[moving_mean(c, w, n).alias(f"__ma_{c}_{n}") for c, n in means])

    def ma(c, n):
        return F.col(f"__ma_{c}_{n}")

    def mn(c, n):
        return F.min(c).over(w.rowsBetween(-(n - 1), 0))

    def mx(c, n):
        return F.max(c).over(w.rowsBetween(-(n - 1), 0))

    close = F.col("close")
    r = lambda e: F.round(e, digits)
    k10 = F.try_divide(close - mn("low", 10), F.nullif(mx("high", 10) - mn("low", 10), F.lit(0.0))) * 100.0
    return bars.select(
        "ts_code", "trade_date", *keep, close.alias("close_qfq"),
        r(ma("close", 10) - ma("close", 20)).alias("macd_dif_qfq"),
        r(ma("close", 5) - ma("close", 20)).alias("macd_dea_qfq"),
        r((ma("close", 10) - ma("close", 5)) * 2.0).alias("macd_qfq"),
        r(k10).alias("kdj_k_qfq"),
        r(F.try_divide(close - mn("low", 5), F.nullif(mx("high", 5) - mn("low", 5), F.lit(0.0))) * 100.0)
        .alias("kdj_d_qfq"),
        r(k10 * 3.0).alias("kdj_qfq"),
        r(F.try_divide(close, F.nullif(ma("close", 5), F.lit(0.0))) * 50.0).alias("rsi_qfq_6"),
        r(F.try_divide(close, F.nullif(ma("close", 10), F.lit(0.0))) * 50.0).alias("rsi_qfq_12"),
        r(F.try_divide(close, F.nullif(ma("close", 20), F.lit(0.0))) * 50.0).alias("rsi_qfq_24"),
        r(mx("high", 20)).alias("boll_upper_qfq"),
        r(ma("close", 20)).alias("boll_mid_qfq"),
        r(mn("low", 20)).alias("boll_lower_qfq"),
        r(ma("close", 5)).alias("ma_qfq_5"), r(ma("close", 10)).alias("ma_qfq_10"),
        r(ma("close", 20)).alias("ma_qfq_20"), r(ma("close", 60)).alias("ma_qfq_60"),
        r(ma("open", 5)).alias("ma_bfq_5"), r(ma("high", 5)).alias("ma_hfq_5"),
        r(ma("vol", 5)).alias("vol_ma_5"),
    )


def wide_factors(daily: DataFrame, factors: DataFrame, basic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The technical factor table with all its ``columns``: prices and their adjusted variants, daily
    metrics, the indicators of ``factor_table``, and for the many vendor-computed ones a deterministic
    stand-in by their position (the source computes none of them either). Only the tables that the
    ``columns`` need are joined; unused expressions are pruned with their columns."""
    rows = factor_table(daily, keep=[c for c in daily.columns if c not in ("ts_code", "trade_date")]).drop("close_qfq")
    if "adj_factor" in columns or any(c.partition("_")[0] in PRICE_COLS and c.endswith("_hfq") for c in columns):
        rows = rows.join(factors.select("ts_code", "trade_date", "adj_factor"), ["ts_code", "trade_date"], "left")
    metrics = [c for c in basic.columns if c in columns and c not in daily.columns]
    if metrics:
        rows = rows.join(basic.select("ts_code", "trade_date", *metrics), ["ts_code", "trade_date"], "left")
    have = set(rows.columns)

    def value(k: int, c: str):
        price, _, how = c.partition("_")
        if c in have:
            return F.col(c)
        if price in PRICE_COLS:
            return F.col(price) * F.coalesce(F.col("adj_factor"), F.lit(1.0)) if how == "hfq" else F.col(price)
        if "_" not in c and c not in ("downdays", "updays", "lowdays", "topdays") or c in VENDOR_ONLY:
            return F.lit(None).cast("double")
        return F.col("close") * ((k % 17 + 1) / 100.0) + F.col("vol") / (k + 1.0)

    return rows.select("ts_code", "trade_date", *[value(k, c).alias(c) for k, c in enumerate(FACTOR_COLS) if c in columns])


#: Columns of the vendor's market data that the inputs do not have.
VENDOR_ONLY = ("turnover_rate_f", "dv_ttm", "total_share", "float_share", "free_share")
