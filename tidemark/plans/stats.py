"""Table overview, per-table statistics and dashboard totals.

All logical tables are measured by the same two aggregates (``measures``): one over
their dates, one over their symbols, both combined before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import month_start
from tidemark.operators.ingest import join_row_count
from tidemark.plans.market import logical_table
from tidemark.sources.bindings import MarketData
from tidemark.sources.schemas import BASE_TABLE_PRIORITY, RESEARCH_TABLES, TIME_SERIES_TABLES

# Table order of the overview, and each table's date / month column.
OVERVIEW_TABLES = ["stock_basic", "daily", "weekly", "adj_factor", "daily_basic", "trade_cal", "report_rc",
                   "stk_factor_pro", "broker_recommend", "stk_surv", "hk_us_basic", "ths_index"]
DATE_COL = {"daily": "trade_date", "weekly": "trade_date", "adj_factor": "trade_date", "daily_basic": "trade_date",
            "stk_factor_pro": "trade_date", "trade_cal": "cal_date", "report_rc": "report_date",
            "stk_surv": "surv_date"}
CODE_COUNTED = ("daily", "weekly", "adj_factor", "daily_basic", "stk_factor_pro", "report_rc", "stk_surv",
                "broker_recommend")
RESEARCH_SET = ("report_rc", "broker_recommend", "stk_surv")


def _day(name: str):
    """The date that a table is measured by (months: their first day), NULL for a table without one."""
    if name == "broker_recommend":
        return month_start(F.col("month"))
    return F.col(DATE_COL[name]) if name in DATE_COL else F.lit(None).cast("date")


def measures(md: MarketData, tables: list[str]) -> DataFrame:
    """table, rows, codes, lo, hi, dates of every listed table: rows, distinct symbols, first, last and distinct dates.

    Two aggregates over all tables at once: dates as one bit mask per (table, month), whose bits are
    counted, and symbols as the groups of (table, symbol). Each reads one column and combines before its
    shuffle; a distinct count over both columns would repeat every row per distinct (Expand).
    """
    plain = [t for t in tables if t != "ths_index"]
    one = md.spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in plain])).alias("table"))
    # the factor table has a row per bar: its rows are counted without its columns
    frames = {t: md.bars() if t == "stk_factor_pro" else logical_table(md, t) for t in plain}
    dated = reduce(DataFrame.unionByName, [df.select(F.lit(t).alias("table"), _day(t).alias("day")) for t, df in frames.items()])
    months = (dated.groupBy("table", (F.year("day") * 12 + F.month("day")).alias("m"))
              .agg(F.count(F.lit(1)).alias("rows"), F.min("day").alias("lo"), F.max("day").alias("hi"),
                   F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.dayofmonth("day"))).alias("mask")))
    by_table = months.groupBy("table").agg(F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                           F.coalesce(F.sum(F.bit_count("mask")), F.lit(0)).cast("bigint").alias("dates"))
    coded = reduce(DataFrame.unionByName, [df.select(F.lit(t).alias("table"), "ts_code") for t, df in frames.items() if t in CODE_COUNTED])
    codes = (coded.where("ts_code IS NOT NULL").groupBy("table", "ts_code").agg(F.lit(1).alias("n"))
             .groupBy("table").agg(F.count("n").alias("codes")))
    out = one.join(by_table, "table", "left").join(codes, "table", "left").select(
        "table", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), F.coalesce("codes", F.lit(0)).cast("bigint").alias("codes"),
        "lo", "hi", F.coalesce("dates", F.lit(0)).cast("bigint").alias("dates"))
    if "ths_index" in tables:  # quotes x members: the fan-out is counted, not built
        n = join_row_count(md.concept_quotes().select("index_code"), md.concept_members().select("index_code"), "index_code")
        none = F.lit(None)
        out = out.unionByName(n.select(F.lit("ths_index").alias("table"), "rows", F.lit(0).cast("bigint").alias("codes"),
                                       none.cast("date").alias("lo"), none.cast("date").alias("hi"), F.lit(0).cast("bigint").alias("dates")))
    return out


def table_overview(md: MarketData) -> DataFrame:
    t = F.col("table")
    as_text = lambda c: F.when(t == "broker_recommend", F.date_format(c, "yyyyMM")).otherwise(F.date_format(c, "yyyy-MM-dd"))
    stocks = F.when(t.isin(list(CODE_COUNTED)), F.col("codes")).when(t.isin("stock_basic", "hk_us_basic"), F.col("rows"))
    return measures(md, OVERVIEW_TABLES).select(t, "rows", as_text("lo").alias("min_date"), as_text("hi").alias("max_date"), stocks.alias("stock_count"))


def overview_totals(md: MarketData) -> DataFrame:
    o = table_overview(md)
    return o.agg(
        F.count(F.lit(1)).alias("table_count"),
        F.sum("rows").alias("total_rows"),
        F.max(F.when(F.col("table") == "stock_basic", F.col("stock_count"))).alias("stock_count"),
        F.count_if(F.col("table").isin(list(TIME_SERIES_TABLES))).alias("time_series_tables"),
        F.count_if(F.col("table").isin(list(RESEARCH_SET))).alias("research_tables"),
    )


STATS_TABLES = OVERVIEW_TABLES + ["stk_surv_detail"]


def table_stats(md: MarketData) -> DataFrame:
    """Per-table statistics; ``position`` puts the base tables first (fixed order),
    then the rest by newest date, tables without dates last."""
    t = F.col("table")
    measured = t.isin([*TIME_SERIES_TABLES, *RESEARCH_TABLES, "stk_surv", "broker_recommend"])
    num_codes = F.when(measured, F.col("codes")).when(t == "stk_surv_detail", F.lit(0).cast("bigint")).otherwise(F.col("rows"))
    s = measures(md, STATS_TABLES).select(
        t.alias("table_name"), F.col("rows").alias("total_rows"), num_codes.alias("num_codes"),
        F.when(measured, F.col("lo")).alias("min_date"), F.when(measured, F.col("hi")).alias("max_date"),
        F.when(measured, F.col("dates")).alias("actual_dates"))
    prio = F.lit(len(BASE_TABLE_PRIORITY))
    for i, t in enumerate(BASE_TABLE_PRIORITY):
        prio = F.when(F.col("table_name") == t, F.lit(i)).otherwise(prio)
    # one row per table: a single ordered window over a dozen rows
    w = Window.orderBy(prio, F.col("max_date").desc_nulls_last(), F.col("table_name"))
    return s.withColumn("position", F.row_number().over(w).cast("bigint"))


QUERIES = {
    "table_overview": table_overview,
    "overview_totals": overview_totals,
    "table_stats": table_stats,
}


def _ov_sql() -> str:
    parts = []
    views = {"stock_basic": "v_stock_basic", "daily": "v_daily", "weekly": "v_weekly", "adj_factor": "v_adj",
             "daily_basic": "v_daily_basic", "trade_cal": "v_trade_cal", "report_rc": "v_report_rc",
             "stk_factor_pro": "v_bars", "broker_recommend": "v_recs", "stk_surv": "v_stk_surv",
             "hk_us_basic": "v_hkus", "ths_index": "v_ths_index", "stk_surv_detail": "v_stk_surv_detail"}
    for t in OVERVIEW_TABLES:
        v = views[t]
        if t in DATE_COL:
            c = DATE_COL[t]
            dates = f"strftime(min({c}), '%Y-%m-%d') AS min_date, strftime(max({c}), '%Y-%m-%d') AS max_date"
        elif t == "broker_recommend":
            dates = "min(month) AS min_date, max(month) AS max_date"
        else:
            dates = "NULL::VARCHAR AS min_date, NULL::VARCHAR AS max_date"
        if t in CODE_COUNTED:
            sc = "count(DISTINCT ts_code)"
        elif t in ("stock_basic", "hk_us_basic"):
            sc = "count(*)"
        else:
            sc = "NULL::BIGINT"
        parts.append(f"SELECT '{t}' AS \"table\", count(*) AS rows, {dates}, {sc} AS stock_count FROM {v}")
    return "\nUNION ALL\n".join(parts)


def _stats_sql() -> str:
    views = {"stock_basic": "v_stock_basic", "daily": "v_daily", "weekly": "v_weekly", "adj_factor": "v_adj",
             "daily_basic": "v_daily_basic", "trade_cal": "v_trade_cal", "report_rc": "v_report_rc",
             "stk_factor_pro": "v_bars", "broker_recommend": "v_recs", "stk_surv": "v_stk_surv",
             "hk_us_basic": "v_hkus", "ths_index": "v_ths_index", "stk_surv_detail": "v_stk_surv_detail"}
    parts = []
    for t in STATS_TABLES:
        v = views[t]
        if t in TIME_SERIES_TABLES or t in RESEARCH_TABLES or t == "stk_surv":
            c = DATE_COL[t]
            sel = f"count(*), count(DISTINCT ts_code), min({c}), max({c}), count(DISTINCT {c})"
        elif t == "broker_recommend":
            sel = ("count(*), count(DISTINCT ts_code), CAST(strptime(min(month) || '01', '%Y%m%d') AS DATE), "
                   "CAST(strptime(max(month) || '01', '%Y%m%d') AS DATE), count(DISTINCT month)")
        elif t == "stk_surv_detail":
            sel = "count(*), 0::BIGINT, NULL::DATE, NULL::DATE, NULL::BIGINT"
        else:
            sel = "count(*), count(*), NULL::DATE, NULL::DATE, NULL::BIGINT"
        parts.append(f"SELECT '{t}', {sel} FROM {v}")
    body = "\nUNION ALL\n".join(parts)
    return f"""
WITH s(table_name, total_rows, num_codes, min_date, max_date, actual_dates) AS ({body})
SELECT *, row_number() OVER (ORDER BY CASE table_name WHEN 'stock_basic' THEN 0 WHEN 'trade_cal' THEN 1
                                      WHEN 'hk_us_basic' THEN 2 ELSE 3 END,
                             max_date DESC NULLS LAST, table_name) AS position FROM s"""


_HKUS_VIEW = """
SELECT ts_code, arg_max(name, (name, enname)) AS name, arg_max(enname, (name, enname)) AS enname
FROM (SELECT ts_code, name, enname FROM v_hk_basic UNION ALL SELECT ts_code, name, enname FROM v_us_basic)
GROUP BY ts_code"""

ORACLE = {
    "table_overview": "WITH v_hkus AS (" + _HKUS_VIEW + ")\nSELECT * FROM (" + _ov_sql() + ")",
    "overview_totals": "WITH v_hkus AS (" + _HKUS_VIEW + "), o AS (" + _ov_sql() + """)
SELECT count(*) AS table_count, CAST(sum(rows) AS BIGINT) AS total_rows,
       max(CASE WHEN "table" = 'stock_basic' THEN stock_count END) AS stock_count,
       count(*) FILTER (WHERE "table" IN ('daily','weekly','adj_factor','daily_basic','stk_factor_pro'))
           AS time_series_tables,
       count(*) FILTER (WHERE "table" IN ('report_rc','broker_recommend','stk_surv')) AS research_tables
FROM o""",
    "table_stats": "WITH v_hkus AS (" + _HKUS_VIEW + ")\nSELECT * FROM (" + _stats_sql() + ")",
}
