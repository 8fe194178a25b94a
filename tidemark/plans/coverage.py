"""Calendar, coverage, gap detection, backfill and incremental-load planning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import month_start
from tidemark.operators import calendar as C
from tidemark.operators.intervals import interval_join
from tidemark.operators.merge import upsert_merge
from tidemark.sources.bindings import MarketData

# Fixed values of the loader.
INCREMENTAL_LOOKBACK_DAYS = 5
FULL_LOOKBACK_YEARS = 10
SCAN_BATCH_SIZE = 100
RESEARCH_DAILY_THRESHOLD_DAYS = 60
# The exchange whose calendar the bar tables are checked against, and "today" of the plans.
CAL_EXCHANGE = "ASIA"
AS_OF = "2001-12-31"


def trade_dates(md: MarketData, exchange: str = CAL_EXCHANGE, start=None, end=None, is_open=True) -> DataFrame:
    return C.trading_days(md.trade_cal(), exchange, start, end, is_open)


def dates_between(md: MarketData, lo: str = "1996-01-01", hi: str = "1996-12-31") -> DataFrame:
    cal = md.trade_cal()
    return cal.where(F.col("cal_date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))


def calendar_range(md: MarketData) -> DataFrame:
    """Min/max calendar date per exchange, including exchanges with no calendar rows
    (NULL range): the exchange list is the region table."""
    cal = md.trade_cal()
    ex = md.table("region", "r_name").select(F.col("r_name").alias("exchange"))
    ex = ex.unionByName(md.spark.range(1).select(F.lit("NOWHERE").alias("exchange")))
    r = cal.groupBy("exchange").agg(F.min("cal_date").alias("min_date"), F.max("cal_date").alias("max_date"))
    return ex.join(r, "exchange", "left")


def event_calendar(md: MarketData) -> DataFrame:
    return C.every_day_calendar(md.event_days(), "day")


def coverage_report(md: MarketData) -> DataFrame:
    """Per user: first/last active day, active days, expected days, missing, pct."""
    return C.coverage_report(md.event_days(), "user_id", "day", event_calendar(md))


def coverage_bars(md: MarketData) -> DataFrame:
    """Per symbol of the daily table against the exchange calendar; symbols of the
    master without any bar get a zero row."""
    cal = md.trade_cal().where(F.col("exchange") == CAL_EXCHANGE)
    codes = md.stock_basic().select("ts_code").unionByName(
        md.spark.range(1).select(F.lit("S-UNKNOWN").alias("ts_code")))
    return C.coverage_report(md.bars().select("ts_code", "trade_date"), "ts_code", "trade_date", cal, codes)


def missing_dates(md: MarketData) -> DataFrame:
    return C.missing_dates(md.event_days(), "user_id", "day", event_calendar(md))


def missing_bars(md: MarketData) -> DataFrame:
    cal = md.trade_cal().where(F.col("exchange") == CAL_EXCHANGE)
    return C.missing_dates(md.bars().select("ts_code", "trade_date"), "ts_code", "trade_date", cal)


def backfill_plan(md: MarketData) -> DataFrame:
    return C.backfill_plan(missing_bars(md), "ts_code", "missing_date", SCAN_BATCH_SIZE)


def backfill_apply(md: MarketData) -> DataFrame:
    """Gap fill end to end on the event table: the stored days before 2024-01-16 with
    every fifth day dropped, scanned against the every-day calendar; each planned
    (user, chunk) range is read from the landing data (all events) by an interval join on
    the user, and upserted. Result: the repaired table."""
    days = md.event_days()
    stored = days.where((F.col("day") < F.lit("2024-01-16").cast("date")) & (F.dayofmonth("day") % 5 != 0))
    plan = C.backfill_plan(C.missing_dates(stored, "user_id", "day", C.every_day_calendar(stored, "day")),
                           "user_id", "missing_date", 5)
    landing = days
    fill = interval_join(landing, plan, ["user_id"], "day", "start_date", "end_date", "left_semi").select("user_id", "day")
    merged = upsert_merge(stored.withColumn("src", F.lit("stored")),
                          fill.withColumn("src", F.lit("filled")), ["user_id", "day"], [])
    return merged


def high_water(md: MarketData) -> DataFrame:
    """Newest date per symbol (the per-symbol high-water mark)."""
    return md.bars().groupBy("ts_code").agg(F.max("trade_date").alias("high_water"))


def high_water_marks(md: MarketData) -> DataFrame:
    """All high-water marks the loader uses, as (kind, key, mark) strings: newest bar per
    symbol, newest calendar day per exchange, newest date per dated table and the newest
    recommendation month."""
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd")
    sym = md.bars().groupBy(F.col("ts_code").alias("key")).agg(fmt(F.max("trade_date")).alias("mark")) \
        .select(F.lit("symbol").alias("kind"), "key", "mark")
    exch = md.trade_cal().groupBy(F.col("exchange").alias("key")).agg(fmt(F.max("cal_date")).alias("mark")) \
        .select(F.lit("exchange").alias("kind"), "key", "mark")
    tables = [("daily", md.bars(), "trade_date"), ("adj_factor", md.adj_factor(), "trade_date"),
              ("report_rc", md.report_rc(), "report_date"), ("stk_surv", md.stk_surv(), "surv_date")]
    tabs = [df.agg(fmt(F.max(c)).alias("mark")).select(F.lit("table").alias("kind"), F.lit(n).alias("key"), "mark")
            for n, df, c in tables]
    month = md.broker_recommend().agg(F.max("month").alias("mark")).select(
        F.lit("month").alias("kind"), F.lit("broker_recommend").alias("key"), "mark")
    out = sym.unionByName(exch)
    for t in tabs:
        out = out.unionByName(t)
    return out.unionByName(month)


def load_ranges(md: MarketData, as_of: str = AS_OF) -> DataFrame:
    """Next load range per symbol of the master: after the high-water mark minus
    the look-back, or the full look-back for a symbol with no data."""
    hw = high_water(md)
    today = F.lit(as_of).cast("date")
    start = F.coalesce(F.date_sub("high_water", INCREMENTAL_LOOKBACK_DAYS),
                       F.date_sub(today, 365 * FULL_LOOKBACK_YEARS))
    return (md.stock_basic().select("ts_code").join(hw, "ts_code", "left")
            .select("ts_code", "high_water", start.alias("start_date"), today.alias("end_date"),
                    F.when(F.col("high_water").isNull(), "full").otherwise("incremental").alias("mode")))


def table_load_ranges(md: MarketData, as_of: str = AS_OF, start: str | None = None) -> DataFrame:
    """Next load range per dated table, up to ``as_of``: from ``start`` if one is given (explicit), else
    from the day after the newest row (by_day; an empty table looks back a few days) and from the
    newest row minus the look-back (lookback; an empty table takes the full look-back). A range that
    would start after ``as_of`` is up to date and left out."""
    tables = [("daily", md.bars(), "trade_date"), ("report_rc", md.report_rc(), "report_date"),
              ("stk_surv", md.stk_surv(), "surv_date"), ("empty", md.bars().where(F.lit(False)), "trade_date")]
    marks = [df.agg(F.max(day).alias("high_water")).select(F.lit(name).alias("table_name"), "high_water")
             for name, df, day in tables]
    end = F.lit(as_of).cast("date")
    starts = {"explicit": F.lit(start).cast("date")} if start else {
        "by_day": F.coalesce(F.date_add("high_water", 1), F.date_sub(end, INCREMENTAL_LOOKBACK_DAYS)),
        "lookback": F.coalesce(F.date_sub("high_water", INCREMENTAL_LOOKBACK_DAYS),
                               F.date_sub(end, 365 * FULL_LOOKBACK_YEARS))}
    per = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), d.alias("start_date")) for m, d in starts.items()]))
    return (reduce(DataFrame.unionByName, marks).select("table_name", "high_water", per.alias("r"))
            .select("table_name", "high_water", "r.mode", "r.start_date", end.alias("end_date"))
            .where(F.col("start_date") <= F.col("end_date")))


def requested_ranges(md: MarketData) -> DataFrame:
    """Research load ranges: per (org, quarter) and per (org, year) of ``report_rc``."""
    r = md.report_rc().select("org_name", "report_date", "quarter")
    q = r.groupBy("org_name", F.col("quarter").alias("range_id")).agg(
        F.min("report_date").alias("start_date"), F.max("report_date").alias("end_date"))
    y = r.groupBy("org_name", F.year("report_date").cast("string").alias("range_id")).agg(
        F.min("report_date").alias("start_date"), F.max("report_date").alias("end_date"))
    return q.unionByName(y)


def period_plan(md: MarketData, threshold: int = RESEARCH_DAILY_THRESHOLD_DAYS) -> DataFrame:
    """Each research range split by day if it spans <= ``threshold`` days, else by
    calendar quarter clipped to the range; an empty range gives nothing."""
    return C.period_plan(requested_ranges(md), threshold, keys=("org_name", "range_id"))


def month_plan(md: MarketData) -> DataFrame:
    """Per broker: every month from its first to its last recommendation month, with
    month start and month end."""
    b = md.broker_recommend().groupBy("broker").agg(month_start(F.min("month")).alias("start_date"),
                                                   month_start(F.max("month")).alias("end_date"))
    return C.month_plan(b, keys=("broker",))


def open_day_plan(md: MarketData, as_of: str = AS_OF) -> DataFrame:
    """Per symbol: the open calendar days of its next load range."""
    r = load_ranges(md, as_of)
    days = r.select("ts_code", F.explode(F.when(F.col("start_date") <= F.col("end_date"),
                                               F.sequence("start_date", "end_date"))).alias("trade_date"))
    od = C.open_days(md.trade_cal(), CAL_EXCHANGE).select(F.col("cal_date").alias("trade_date"))
    return days.join(F.broadcast(od), "trade_date", "left_semi")


def incremental_apply(md: MarketData, cut: str = "2000-01-01", revised: float = 0.0) -> DataFrame:
    """Incremental load: stored bars before ``cut``; the landing batch is every bar
    from each symbol's high-water mark minus the look-back on, its close raised by
    ``revised``; upserted by key, so the batch's rows replace the stored ones."""
    bars = md.bars()
    stored = bars.where(F.col("trade_date") < F.lit(cut).cast("date"))
    hw = stored.groupBy("ts_code").agg(F.max("trade_date").alias("__hw"))
    batch = (bars.join(hw, "ts_code", "left")
             .where(F.col("__hw").isNull() |
                    (F.col("trade_date") >= F.date_sub("__hw", INCREMENTAL_LOOKBACK_DAYS)))
             .drop("__hw").withColumn("close", F.col("close") + F.lit(revised)))
    return upsert_merge(stored, batch, ["ts_code", "trade_date"], [])


QUERIES = {
    "trade_dates": trade_dates,
    "dates_between": dates_between,
    "calendar_range": calendar_range,
    "coverage_report": coverage_report,
    "coverage_bars": coverage_bars,
    "missing_dates": missing_dates,
    "missing_bars": missing_bars,
    "backfill_plan": backfill_plan,
    "backfill_apply": backfill_apply,
    "high_water": high_water,
    "high_water_marks": high_water_marks,
    "load_ranges": load_ranges,
    "table_load_ranges": lambda md: table_load_ranges(md).unionByName(table_load_ranges(md, start="2001-01-01")),
    "period_plan": period_plan,
    "month_plan": month_plan,
    "open_day_plan": open_day_plan,
    "incremental_apply": incremental_apply,
    "incremental_revised": lambda md: incremental_apply(md, "1997-07-01", revised=1.0),
}

_EV_CAL = """
SELECT CAST(d AS DATE) AS cal_date FROM generate_series((SELECT min(day) FROM v_event_days),
                                                        (SELECT max(day) FROM v_event_days), INTERVAL 1 DAY) t(d)"""
_MISSING_BARS = """
WITH b AS (SELECT ts_code, min(trade_date) AS lo, max(trade_date) AS hi FROM v_bars GROUP BY ts_code)
SELECT b.ts_code, c.cal_date AS missing_date FROM b JOIN v_trade_cal c
  ON c.exchange = 'ASIA' AND c.is_open AND c.cal_date BETWEEN b.lo AND b.hi
WHERE NOT EXISTS (SELECT 1 FROM v_bars x WHERE x.ts_code = b.ts_code AND x.trade_date = c.cal_date)"""


def _cov_sql(series: str, key: str, dcol: str, cal: str, codes: str | None) -> str:
    rep = f"""
WITH b AS (SELECT {key}, min({dcol}) AS min_date, max({dcol}) AS max_date, count(DISTINCT {dcol}) AS actual
           FROM {series} GROUP BY {key}),
e AS (SELECT b.{key}, count(c.cal_date) AS expected FROM b LEFT JOIN ({cal}) c
      ON c.cal_date BETWEEN b.min_date AND b.max_date GROUP BY b.{key}),
r AS (SELECT b.{key}, b.min_date, b.max_date, b.actual, e.expected,
             greatest(e.expected - b.actual, 0) AS missing,
             CASE WHEN e.expected > 0 THEN round(b.actual / e.expected * 100, 2) ELSE 0.0 END AS coverage_pct
      FROM b JOIN e USING ({key}))"""
    if codes is None:
        return rep + "\nSELECT * FROM r"
    return rep + f"""
SELECT k.{key}, r.min_date, r.max_date, coalesce(r.actual, 0) AS actual, coalesce(r.expected, 0) AS expected,
       coalesce(r.missing, 0) AS missing, coalesce(r.coverage_pct, 0.0) AS coverage_pct
FROM (SELECT DISTINCT {key} FROM ({codes})) k LEFT JOIN r USING ({key})"""


ORACLE = {
    "trade_dates": "SELECT * FROM v_trade_cal WHERE exchange = 'ASIA' AND is_open = TRUE",
    "dates_between": "SELECT * FROM v_trade_cal WHERE cal_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'",
    "calendar_range": """
SELECT e.exchange, r.min_date, r.max_date
FROM (SELECT r_name AS exchange FROM region UNION ALL SELECT 'NOWHERE') e
LEFT JOIN (SELECT exchange, min(cal_date) AS min_date, max(cal_date) AS max_date FROM v_trade_cal GROUP BY exchange) r
USING (exchange)""",
    "coverage_report": _cov_sql("v_event_days", "user_id", "day", _EV_CAL, None),
    "coverage_bars": _cov_sql("v_bars", "ts_code", "trade_date",
                              "SELECT cal_date FROM v_trade_cal WHERE exchange = 'ASIA' AND is_open",
                              "SELECT ts_code FROM v_stock_basic UNION ALL SELECT 'S-UNKNOWN'"),
    "missing_dates": f"""
WITH b AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM v_event_days GROUP BY user_id)
SELECT b.user_id, c.cal_date AS missing_date FROM b JOIN ({_EV_CAL}) c ON c.cal_date BETWEEN b.lo AND b.hi
WHERE NOT EXISTS (SELECT 1 FROM v_event_days x WHERE x.user_id = b.user_id AND x.day = c.cal_date)""",
    "missing_bars": _MISSING_BARS,
    "backfill_plan": f"""
SELECT ts_code, chunk, min(missing_date) AS start_date, max(missing_date) AS end_date, count(*) AS n_dates
FROM (SELECT ts_code, missing_date,
             CAST(floor((row_number() OVER (PARTITION BY ts_code ORDER BY missing_date) - 1) / 100) AS BIGINT) AS chunk
      FROM ({_MISSING_BARS})) GROUP BY ts_code, chunk""",
    "backfill_apply": """
WITH stored AS (SELECT user_id, day FROM v_event_days WHERE day < DATE '2024-01-16' AND dayofmonth(day) % 5 <> 0),
cal AS (SELECT CAST(d AS DATE) AS cal_date FROM generate_series((SELECT min(day) FROM stored),
                                                                (SELECT max(day) FROM stored), INTERVAL 1 DAY) t(d)),
b AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM stored GROUP BY user_id),
miss AS (SELECT b.user_id, c.cal_date AS missing_date FROM b JOIN cal c ON c.cal_date BETWEEN b.lo AND b.hi
         WHERE NOT EXISTS (SELECT 1 FROM stored x WHERE x.user_id = b.user_id AND x.day = c.cal_date)),
plan AS (SELECT user_id, chunk, min(missing_date) AS start_date, max(missing_date) AS end_date FROM (
           SELECT user_id, missing_date,
                  floor((row_number() OVER (PARTITION BY user_id ORDER BY missing_date) - 1) / 5) AS chunk
           FROM miss) GROUP BY user_id, chunk),
fill AS (SELECT DISTINCT l.user_id, l.day FROM v_event_days l JOIN plan p ON l.user_id = p.user_id
         AND l.day BETWEEN p.start_date AND p.end_date)
SELECT user_id, day, arg_max(src, prio) AS src
FROM (SELECT user_id, day, 'stored' AS src, 0 AS prio FROM stored
      UNION ALL SELECT user_id, day, 'filled', 1 FROM fill) GROUP BY user_id, day""",
    "high_water": "SELECT ts_code, max(trade_date) AS high_water FROM v_bars GROUP BY ts_code",
    "high_water_marks": """
SELECT 'symbol' AS kind, ts_code AS key, strftime(max(trade_date), '%Y-%m-%d') AS mark FROM v_bars GROUP BY ts_code
UNION ALL SELECT 'exchange', exchange, strftime(max(cal_date), '%Y-%m-%d') FROM v_trade_cal GROUP BY exchange
UNION ALL SELECT 'table', 'daily', strftime(max(trade_date), '%Y-%m-%d') FROM v_bars
UNION ALL SELECT 'table', 'adj_factor', strftime(max(trade_date), '%Y-%m-%d') FROM v_adj
UNION ALL SELECT 'table', 'report_rc', strftime(max(report_date), '%Y-%m-%d') FROM v_report_rc
UNION ALL SELECT 'table', 'stk_surv', strftime(max(surv_date), '%Y-%m-%d') FROM v_stk_surv
UNION ALL SELECT 'month', 'broker_recommend', max(month) FROM v_recs""",
    "load_ranges": """
SELECT s.ts_code, h.high_water,
       coalesce(CAST(h.high_water - INTERVAL 5 DAY AS DATE), CAST(DATE '2001-12-31' - INTERVAL 3650 DAY AS DATE))
           AS start_date, DATE '2001-12-31' AS end_date,
       CASE WHEN h.high_water IS NULL THEN 'full' ELSE 'incremental' END AS mode
FROM v_stock_basic s LEFT JOIN (SELECT ts_code, max(trade_date) AS high_water FROM v_bars GROUP BY ts_code) h
USING (ts_code)""",
    "period_plan": """
WITH r AS (SELECT org_name, quarter AS range_id, min(report_date) AS start_date, max(report_date) AS end_date
           FROM v_report_rc GROUP BY org_name, quarter
           UNION ALL
           SELECT org_name, CAST(year(report_date) AS VARCHAR), min(report_date), max(report_date)
           FROM v_report_rc GROUP BY org_name, year(report_date))
SELECT org_name, range_id, CAST(d AS DATE) AS period_start, CAST(d AS DATE) AS period_end, 'day' AS mode
FROM r, generate_series(start_date, end_date, INTERVAL 1 DAY) t(d)
WHERE start_date <= end_date AND datediff('day', start_date, end_date) <= 60
UNION ALL
SELECT org_name, range_id, greatest(CAST(q AS DATE), start_date) AS period_start,
       least(CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE), end_date) AS period_end, 'quarter' AS mode
FROM r, generate_series(CAST(date_trunc('quarter', start_date) AS DATE), end_date, INTERVAL 3 MONTH) t(q)
WHERE start_date <= end_date AND datediff('day', start_date, end_date) > 60""",
    "month_plan": """
WITH b AS (SELECT broker, CAST(strptime(min(month) || '01', '%Y%m%d') AS DATE) AS lo,
                  CAST(strptime(max(month) || '01', '%Y%m%d') AS DATE) AS hi FROM v_recs GROUP BY broker)
SELECT broker, strftime(m, '%Y%m') AS month, CAST(m AS DATE) AS month_start, CAST(last_day(m) AS DATE) AS month_end
FROM b, generate_series(lo, hi, INTERVAL 1 MONTH) t(m) WHERE lo <= hi""",
    "open_day_plan": """
WITH h AS (SELECT ts_code, max(trade_date) AS high_water FROM v_bars GROUP BY ts_code),
r AS (SELECT s.ts_code, coalesce(CAST(h.high_water - INTERVAL 5 DAY AS DATE),
                                 CAST(DATE '2001-12-31' - INTERVAL 3650 DAY AS DATE)) AS start_date
      FROM v_stock_basic s LEFT JOIN h USING (ts_code))
SELECT CAST(d AS DATE) AS trade_date, r.ts_code FROM r, generate_series(r.start_date, DATE '2001-12-31', INTERVAL 1 DAY) t(d)
WHERE CAST(d AS DATE) IN (SELECT cal_date FROM v_trade_cal WHERE exchange = 'ASIA' AND is_open)""",
    "incremental_apply": "SELECT * FROM v_bars",
    "incremental_revised": """
SELECT b.* REPLACE (CASE WHEN h.hw IS NULL OR b.trade_date >= h.hw - INTERVAL 5 DAY THEN b.close + 1.0 ELSE b.close END
                    AS close)
FROM v_bars b LEFT JOIN (SELECT ts_code, max(trade_date) AS hw FROM v_bars WHERE trade_date < DATE '1997-07-01'
                         GROUP BY ts_code) h USING (ts_code)""",
    "table_load_ranges": """
WITH m AS (SELECT 'daily' AS table_name, max(trade_date) AS high_water FROM v_bars
           UNION ALL SELECT 'report_rc', max(report_date) FROM v_report_rc
           UNION ALL SELECT 'stk_surv', max(surv_date) FROM v_stk_surv
           UNION ALL SELECT 'empty', NULL),
r AS (SELECT *, 'by_day' AS mode, CASE WHEN high_water IS NULL THEN DATE '2001-12-26' ELSE high_water + 1 END AS start_date
      FROM m
      UNION ALL
      SELECT *, 'lookback', CASE WHEN high_water IS NULL THEN DATE '2001-12-31' - 3650 ELSE high_water - 5 END FROM m
      UNION ALL
      SELECT *, 'explicit', DATE '2001-01-01' FROM m)
SELECT table_name, high_water, mode, start_date, DATE '2001-12-31' AS end_date FROM r
WHERE start_date <= DATE '2001-12-31'""",
}
