"""Bars, masters, metrics, research, surveys and concept lookups.

Each lookup of the source application takes one symbol; here each runs for
every symbol at once and keeps the optional filters as arguments (pushed into
the Parquet scan through Catalyst).
"""

from __future__ import annotations

import datetime as _dt
import re
from string import Formatter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import any_contains, contains_like, date_range, eq, in_list, not_blank, where_all
from tidemark.functions.text import rating_class as rating_class_expr
from tidemark.operators import bars as B
from tidemark.operators.ingest import union_ragged
from tidemark.operators.merge import align_schema, latest_per_key
from tidemark.operators.ordering import with_position
from tidemark.sources.bindings import MarketData
from tidemark.sources.schemas import FACTOR_COLS, SPECS, spec

# Column lists of the indicator and metrics lookups.
INDICATOR_COLS = ["trade_date", "macd_dif_qfq", "macd_dea_qfq", "macd_qfq", "kdj_k_qfq", "kdj_d_qfq", "kdj_qfq",
                  "rsi_qfq_6", "rsi_qfq_12", "rsi_qfq_24", "boll_upper_qfq", "boll_mid_qfq", "boll_lower_qfq",
                  "ma_qfq_5", "ma_qfq_10", "ma_qfq_20", "ma_qfq_60"]
METRIC_COLS = ["trade_date", "close", "pe", "pe_ttm", "pb", "ps", "ps_ttm", "turnover_rate", "volume_ratio",
               "total_mv", "circ_mv", "dv_ratio"]


# -- bars --------------------------------------------------------------------
def bars(md: MarketData, ts_codes=None, start=None, end=None) -> DataFrame:
    """Daily bars, optional symbol list and date range (K3 / C1)."""
    return where_all(md.daily(), in_list("ts_code", ts_codes), date_range("trade_date", start, end))


def close_series(md: MarketData, ts_codes=None, start=None, end=None) -> DataFrame:
    return where_all(md.bars(), in_list("ts_code", ts_codes), date_range("trade_date", start, end)) \
        .select("ts_code", "trade_date", "close")


def adj_factors(md: MarketData, ts_codes=None, start=None, end=None) -> DataFrame:
    return where_all(md.adj_factor(), in_list("ts_code", ts_codes), date_range("trade_date", start, end))


def _kline(md: MarketData, mode, table="daily", start=None, end=None, limit=None) -> DataFrame:
    src = md.bars() if table == "daily" else md.weekly()
    src = where_all(src, date_range("trade_date", start, end))
    out = B.kline_records(B.adjust(src, md.adj_factor(), mode))
    if limit is not None:  # the oldest ``limit`` bars per symbol
        w = Window.partitionBy("ts_code").orderBy("time")
        out = out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")
    return out


def kline_qfq(md: MarketData, **kw) -> DataFrame:
    """Forward-adjusted bars for all symbols: ``p * coalesce(f, 1) / max factor``."""
    return _kline(md, "qfq", **kw)


def kline_hfq(md: MarketData, **kw) -> DataFrame:
    """Back-adjusted variant: ``p / coalesce(nullif(f, 0), 1) * max factor``."""
    return _kline(md, "hfq", **kw)


def kline_weekly_qfq(md: MarketData) -> DataFrame:
    return _kline(md, "qfq", table="weekly")


def moving_avg(md: MarketData) -> DataFrame:
    """MA 5/10/20/60 of the forward-adjusted close (NULL until the window is full)."""
    q = B.adjust(md.bars(), md.adj_factor(), "qfq")
    return B.moving_avg(q, (5, 10, 20, 60))


def bars_resample(md: MarketData) -> DataFrame:
    return B.resample(md.bars(), "week")


def bars_monthly(md: MarketData) -> DataFrame:
    return B.resample(md.bars(), "month")


def bar_flags(md: MarketData) -> DataFrame:
    return B.bar_flags(md.bars(), md.daily_basic())


def preview(md: MarketData, n: int = 20) -> DataFrame:
    """First ``n`` rows of the daily table in key order (the table preview)."""
    return md.daily().orderBy("ts_code", "trade_date").limit(n)


def sql(md: MarketData, text: str, **args) -> DataFrame:
    """SQL over the logical tables: ``{daily}`` in the text is the table of that name, ``:x`` a bound value.

    Only the tables that the text names are bound, to this call alone, so calls on different data run
    side by side.
    """
    names = {n for _, n, _, _ in Formatter().parse(text) if n}
    if unknown := names - set(SPECS):
        raise ValueError(f"no such table: {sorted(unknown)}")
    return md.spark.sql(text, args=args, **{n: logical_table(md, n) for n in names})


def logical_table(md: MarketData, name: str) -> DataFrame:
    return hk_us_master(md) if name == "hk_us_basic" else getattr(md, name)()


def sql_param(md: MarketData, ts_code: str, start: str) -> DataFrame:
    """Bound-parameter SQL over one table (never string-built)."""
    return sql(md, "SELECT ts_code, trade_date, close FROM {daily} WHERE ts_code = :code AND trade_date >= :start",
               code=ts_code, start=_dt.date.fromisoformat(start))


def sql_tables(md: MarketData) -> DataFrame:
    """SQL over several logical tables at once."""
    return sql(md, """
SELECT b.industry, r.broker, count(*) AS picks, max(p.high_water) AS newest
FROM {broker_recommend} r JOIN {stock_basic} b ON b.ts_code = r.ts_code
JOIN (SELECT ts_code, max(trade_date) AS high_water FROM {daily} WHERE trade_date < :until GROUP BY ts_code) p ON p.ts_code = r.ts_code
WHERE r.month BETWEEN :lo AND :hi GROUP BY b.industry, r.broker""", until=_dt.date(1998, 1, 1), lo="199601", hi="199612")


# -- ordered lookups --------------------------------------------------------------
def bars_ordered(md: MarketData) -> DataFrame:
    """Daily bars in the order of (symbol, date)."""
    return with_position(md.daily(), ["ts_code", "trade_date"])


def adj_factors_ordered(md: MarketData) -> DataFrame:
    return with_position(md.adj_factor(), ["ts_code", "trade_date"])


def metrics_ordered(md: MarketData) -> DataFrame:
    return with_position(daily_metrics(md, start="1996-01-01", end="1996-12-31"), ["ts_code", "trade_date"])


def surveys_ordered(md: MarketData) -> DataFrame:
    """Surveys, the newest first, then by symbol."""
    return with_position(surveys(md), [F.col("surv_date").desc(), "ts_code"])


def recs_ordered(md: MarketData) -> DataFrame:
    """Recommendations by month (newest first), broker and symbol."""
    return with_position(md.broker_recommend(), [F.col("month").desc(), "broker", "ts_code"])


def concept_rows_limited(md: MarketData, index_code: str = "Brand#13", limit: int = 300) -> DataFrame:
    """The newest rows of one concept by date (newest first), concept and member, at most ``limit``."""
    return with_position(concept_rows(md, index_code=index_code), [F.col("trade_date").desc(), "index_code", "ts_code"], limit)


# -- technical factors, all columns ---------------------------------------------------
def factors_all(md: MarketData, ts_codes=("S1", "S2"), start="1996-01-01", end="1997-12-31") -> DataFrame:
    """All columns of the technical factor table for some symbols and dates, in the order of (symbol, date)."""
    rows = where_all(md.stk_factor_pro(), in_list("ts_code", ts_codes), date_range("trade_date", start, end))
    return with_position(rows, ["ts_code", "trade_date"])


# -- metrics -----------------------------------------------------------------
def daily_metrics(md: MarketData, ts_codes=None, start=None, end=None) -> DataFrame:
    return where_all(md.daily_basic(), in_list("ts_code", ts_codes), date_range("trade_date", start, end)) \
        .select("ts_code", *METRIC_COLS)


def indicator_subset(md: MarketData) -> DataFrame:
    """16 indicator columns + date out of the wide indicator table."""
    return md.stk_factor_pro(INDICATOR_COLS).select("ts_code", *INDICATOR_COLS)


# -- masters -----------------------------------------------------------------
def securities(md: MarketData, ts_code=None, industry=None, list_status="L") -> DataFrame:
    return where_all(md.stock_basic(), eq("ts_code", ts_code), eq("industry", industry),
                     eq("list_status", list_status))


def symbols(md: MarketData, industry=None) -> DataFrame:
    return where_all(md.stock_basic(), eq("industry", industry)).select("ts_code")


def hk_us_master(md: MarketData) -> DataFrame:
    """The second-market master: both sources unioned, aligned to 3 columns, one row per code."""
    u = union_ragged([md.hk_basic(), md.us_basic()])
    aligned, _ = align_schema(u, spec("hk_us_basic").schema)
    return latest_per_key(aligned, ["ts_code"], ["name", "enname"])


def securities_hk_us(md: MarketData, ts_code=None) -> DataFrame:
    return where_all(hk_us_master(md), eq("ts_code", ts_code))


def security_latest(md: MarketData) -> DataFrame:
    """Every security with its latest metrics row (left join; NULLs if none)."""
    db = md.daily_basic()
    latest = db.groupBy("ts_code").agg(F.max_by(F.struct(*[c for c in db.columns if c != "ts_code"]),
                                                "trade_date").alias("m"))
    return md.stock_basic().join(latest, "ts_code", "left").select(
        "ts_code", "name", "industry", "area", "list_status",
        *[F.col(f"m.{c}").alias(c) for c in ("trade_date", "close", "pe", "pb", "turnover_rate", "total_mv")])


def symbol_search(md: MarketData, q: str) -> DataFrame:
    """Substring search over the main master; if it finds nothing, the second master.

    Both are searched in one plan; rows of the best source that matched are kept
    (a scalar subquery picks it, no driver-side emptiness check).
    """
    a = md.stock_basic().where(any_contains(["ts_code", "name", "fullname", "cnspell"], q)).select(
        "ts_code", "name", "fullname", "industry", "area", "market", "exchange", "list_date",
        F.lit(1).alias("__src"))
    b = hk_us_master(md).where(any_contains(["ts_code", "name", "enname"], q)).select(
        "ts_code", "name", "enname", F.lit(2).alias("__src"))
    u = union_ragged([a, b])
    best = u.select(F.min("__src")).scalar()
    return u.where(F.col("__src") == best).drop("__src")


def industry_dist(md: MarketData) -> DataFrame:
    return (md.stock_basic().where(not_blank("industry"))
            .groupBy("industry").agg(F.count(F.lit(1)).alias("cnt")))


def industry_top_other(md: MarketData, top: int = 10) -> DataFrame:
    """Top-``top`` industries by count plus one 'other' bucket with the rest."""
    d = industry_dist(md)
    w = Window.orderBy(F.col("cnt").desc(), F.col("industry"))  # one row per industry: small
    r = d.withColumn("__r", F.row_number().over(w))
    return (r.groupBy(F.when(F.col("__r") <= top, F.col("industry")).otherwise(F.lit("other")).alias("industry"))
            .agg(F.sum("cnt").alias("cnt")))


# -- research ------------------------------------------------------------------
def reports(md: MarketData, ts_code=None, start=None, end=None, org=None) -> DataFrame:
    return where_all(md.report_rc(), eq("ts_code", ts_code), date_range("report_date", start, end),
                     contains_like("org_name", org))


def _latest(df: DataFrame, day: str, tie: str, limit: int) -> DataFrame:
    """The newest ``limit`` rows per symbol; equal days in the order of ``tie``."""
    w = Window.partitionBy("ts_code").orderBy(F.col(day).desc(), F.col(tie))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def reports_latest(md: MarketData, limit: int = 200, **filters) -> DataFrame:
    """The newest ``limit`` reports of every symbol."""
    return _latest(reports(md, **filters), "report_date", "report_title", limit)


def eps_trend(md: MarketData, ts_code=None, start=None, end=None) -> DataFrame:
    r = where_all(md.report_rc(), eq("ts_code", ts_code), date_range("report_date", start, end),
                  F.col("eps").isNotNull())
    return r.select("ts_code", "report_date", "org_name", "quarter", "eps", "pe", "rating", "max_price")


def research_orgs(md: MarketData, top: int = 50) -> DataFrame:
    c = (md.report_rc().where(F.col("org_name").isNotNull())
         .groupBy("org_name").agg(F.count(F.lit(1)).alias("cnt")))
    return c.orderBy(F.col("cnt").desc(), F.col("org_name")).limit(top)


def rating_class(md: MarketData, rating="rating") -> DataFrame:
    return (md.report_rc().groupBy(rating_class_expr(rating).alias("rating_class"))
            .agg(F.count(F.lit(1)).alias("cnt")))


# -- surveys -------------------------------------------------------------------
def surveys(md: MarketData, ts_code=None, start=None, end=None) -> DataFrame:
    return where_all(md.stk_surv(), eq("ts_code", ts_code), date_range("surv_date", start, end))


def surveys_latest(md: MarketData, limit: int = 100, **filters) -> DataFrame:
    """The newest ``limit`` surveys of every symbol."""
    return _latest(surveys(md, **filters), "surv_date", "rece_org", limit)


def surveys_with_content(md: MarketData, ts_code=None, start=None, end=None) -> DataFrame:
    s = surveys(md, ts_code, start, end)
    return s.join(md.stk_surv_detail(), ["ts_code", "surv_date", "rece_org"], "left")


# -- concepts ------------------------------------------------------------------
def concept_rows(md: MarketData, index_code=None, ts_code=None, index_name=None, start=None, end=None):
    """Rows of the concept table; what concerns one side only is asked of the quotes or the members before they meet."""
    from tidemark.operators.ingest import concept_denorm
    quotes = where_all(md.concept_quotes(), eq("index_code", index_code), date_range("trade_date", start, end))
    members = where_all(md.concept_members(), eq("index_code", index_code), eq("ts_code", ts_code))
    return where_all(concept_denorm(quotes, members, md.concept_meta()), contains_like("index_name", index_name))


def concepts_of_symbol(md: MarketData, ts_code=None) -> DataFrame:
    """Distinct (member, concept, name) of the concept table.

    The concept table is quotes x members; its distinct member-side projection is
    the members whose concept has at least one quote, so the plan semi-joins the
    members with the quoted concepts instead of expanding every (day, member) row
    and de-duplicating it again."""
    quoted = md.concept_quotes().select("index_code")
    members = where_all(md.concept_members(), eq("ts_code", ts_code)).join(quoted, "index_code", "left_semi")
    return (members.join(md.concept_meta(), "index_code", "left")
            .select("ts_code", "index_code", F.coalesce("index_name", F.lit("")).alias("index_name"))
            .distinct())


def concept_daily(md: MarketData, index_code=None) -> DataFrame:
    """Concept bars without the member fan-out: quotes of concepts that have members
    (semi-join), with the name lookup; one row per (concept, day) already."""
    from tidemark.operators.ingest import concept_denorm
    q = where_all(md.concept_quotes(), eq("index_code", index_code))
    q = q.join(md.concept_members().select("index_code"), "index_code", "left_semi")
    return concept_denorm(q, None, md.concept_meta()).drop("ts_code", "name")


# ---------------------------------------------------------------------------
#: A rating text of every class per order priority; other priorities stay unrated.
MIXED_RATINGS = {"1-URGENT": "买入", "2-HIGH": "Strong Buy", "3-MEDIUM": "中性", "4-NOT SPECIFIED": "SELL", "5-LOW": ""}


def _mixed_rating():
    out = F.lit(None).cast("string")
    for priority, text in MIXED_RATINGS.items():
        out = F.when(F.col("rating") == priority, F.lit(text)).otherwise(out)
    return out


QUERIES = {
    "bars": bars,
    "bars_filtered": lambda md: bars(md, ["S1", "S3", "S7"], "1995-01-01", "1996-12-31"),
    "close_series": close_series,
    "adj_factors": adj_factors,
    "kline_limited": lambda md: kline_qfq(md, start="1995-01-01", limit=60),
    "kline_qfq": kline_qfq,
    "kline_hfq": kline_hfq,
    "kline_weekly_qfq": kline_weekly_qfq,
    "moving_avg": moving_avg,
    "bars_resample": bars_resample,
    "bars_monthly": bars_monthly,
    "bar_flags": bar_flags,
    "preview": preview,
    "sql_tables": sql_tables,
    "bars_ordered": bars_ordered,
    "adj_factors_ordered": adj_factors_ordered,
    "metrics_ordered": metrics_ordered,
    "surveys_ordered": surveys_ordered,
    "recs_ordered": recs_ordered,
    "concept_rows_limited": concept_rows_limited,
    "factors_all": factors_all,
    "sql_param": lambda md: sql_param(md, "S1", "1996-01-01"),
    "daily_metrics": daily_metrics,
    "indicator_subset": indicator_subset,
    "securities": securities,
    "symbols": symbols,
    "securities_hk_us": securities_hk_us,
    "security_latest": security_latest,
    "symbol_search": lambda md: symbol_search(md, "Customer#0000001"),
    "symbol_search_main": lambda md: symbol_search(md, "Supplier#00000000"),
    "industry_dist": industry_dist,
    "industry_top_other": industry_top_other,
    "reports": lambda md: reports(md, org="NATION_1"),
    "reports_latest": reports_latest,
    "eps_trend": eps_trend,
    "research_orgs": research_orgs,
    "rating_class": rating_class,
    "rating_class_mixed": lambda md: rating_class(md, _mixed_rating()),
    "surveys": surveys,
    "surveys_latest": surveys_latest,
    "surveys_with_content": surveys_with_content,
    "concept_rows": lambda md: concept_rows(md, index_name="Brand#1"),
    "concepts_of_symbol": concepts_of_symbol,
    "concept_daily": concept_daily,
}

_ADJ = """
WITH lf AS (SELECT ts_code, coalesce(max(adj_factor), 1) AS f FROM v_adj GROUP BY ts_code)
SELECT d.ts_code, d.trade_date AS time, {o} AS open, {h} AS high, {l} AS low, {c} AS close,
       d.vol AS volume, d.amount
FROM {src} d LEFT JOIN v_adj a ON d.ts_code = a.ts_code AND d.trade_date = a.trade_date
LEFT JOIN lf ON d.ts_code = lf.ts_code"""


def _adj_sql(mode: str, src: str = "v_bars") -> str:
    if mode == "qfq":
        e = "d.{p} * coalesce(a.adj_factor, 1) / coalesce(lf.f, 1)"
    else:
        e = "d.{p} / coalesce(nullif(a.adj_factor, 0), 1) * coalesce(lf.f, 1)"
    return _ADJ.format(o=e.format(p="open"), h=e.format(p="high"), l=e.format(p="low"), c=e.format(p="close"),
                       src=src)


def _mean(c: str, n: int) -> str:
    """Mean of the last n values, added up in date order; NULL until n rows exist."""
    frame = f"OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {frame} = {n} THEN list_reduce(list(CAST({c} AS DOUBLE)) {frame}, lambda a, b: a + b) / {n} END"


def _ind_sql(extra: bool = False) -> str:
    def ma(c, n):
        return f"({_mean(c, n)})"

    def mn(c, n):
        return f"min({c}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def mx(c, n):
        return f"max({c}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    k10 = f"(close - {mn('low', 10)}) / nullif({mx('high', 10)} - {mn('low', 10)}, 0) * 100"
    cols = {
        "macd_dif_qfq": f"{ma('close', 10)} - {ma('close', 20)}",
        "macd_dea_qfq": f"{ma('close', 5)} - {ma('close', 20)}",
        "macd_qfq": f"({ma('close', 10)} - {ma('close', 5)}) * 2",
        "kdj_k_qfq": k10,
        "kdj_d_qfq": f"(close - {mn('low', 5)}) / nullif({mx('high', 5)} - {mn('low', 5)}, 0) * 100",
        "kdj_qfq": f"({k10}) * 3",
        "rsi_qfq_6": f"close / nullif({ma('close', 5)}, 0) * 50",
        "rsi_qfq_12": f"close / nullif({ma('close', 10)}, 0) * 50",
        "rsi_qfq_24": f"close / nullif({ma('close', 20)}, 0) * 50",
        "boll_upper_qfq": mx("high", 20),
        "boll_mid_qfq": ma("close", 20),
        "boll_lower_qfq": mn("low", 20),
        "ma_qfq_5": ma("close", 5), "ma_qfq_10": ma("close", 10), "ma_qfq_20": ma("close", 20),
        "ma_qfq_60": ma("close", 60),
    }
    if extra:
        cols |= {"ma_bfq_5": ma("open", 5), "ma_hfq_5": ma("high", 5)}
    sel = ", ".join(f"round({e}, 4) AS {k}" for k, e in cols.items())
    return f"SELECT ts_code, trade_date, {sel} FROM v_bars WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)"


def _factors_sql() -> str:
    """Every column of the factor table: known ones by their formulas, the others by the stand-in of their position."""
    ind = _ind_sql(extra=True)
    known = set(re.findall(r"AS (\w+)", ind)) & set(FACTOR_COLS)
    metrics = {"turnover_rate", "volume_ratio", "pe", "pe_ttm", "pb", "ps", "ps_ttm", "dv_ratio", "total_mv", "circ_mv"}
    none = {"turnover_rate_f", "dv_ttm", "total_share", "float_share", "free_share"}
    cols = []
    for k, c in enumerate(FACTOR_COLS):
        price, _, how = c.partition("_")
        if c in known:
            e = f"i.{c}"
        elif price in ("open", "high", "low", "close"):
            e = f"d.{price} * coalesce(a.adj_factor, 1.0)" if how == "hfq" else f"d.{price}"
        elif c in metrics:
            e = f"b.{c}"
        elif c in ("pre_close", "change", "pct_chg", "vol", "amount"):
            e = f"d.{c}"
        elif c == "adj_factor":
            e = "a.adj_factor"
        elif c in none:
            e = "NULL::DOUBLE"
        else:
            e = f"d.close * {(k % 17 + 1) / 100.0!r}::DOUBLE + d.vol / {k + 1.0!r}::DOUBLE"
        cols.append(f"{e} AS {c}")
    on = "USING (ts_code, trade_date)"
    return (f"SELECT ts_code, trade_date, {', '.join(cols)} FROM v_daily d JOIN ({ind}) i {on} "
            f"LEFT JOIN v_adj a {on} LEFT JOIN v_daily_basic b {on}")


def _position(rows: str, order: str, rest: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {order}, {rest}) AS position FROM ({rows})"


_HKUS = """
SELECT ts_code, arg_max(name, (name, enname)) AS name, arg_max(enname, (name, enname)) AS enname
FROM (SELECT ts_code, name, enname FROM v_hk_basic UNION ALL SELECT ts_code, name, enname FROM v_us_basic)
GROUP BY ts_code"""

_SEARCH = """
WITH a AS (SELECT ts_code, name, fullname, industry, area, market, exchange, list_date FROM v_stock_basic
           WHERE ts_code LIKE '%{q}%' OR name LIKE '%{q}%'
              OR fullname LIKE '%{q}%' OR cnspell LIKE '%{q}%'),
b AS (SELECT ts_code, name, enname FROM (""" + _HKUS + """)
      WHERE ts_code LIKE '%{q}%' OR name LIKE '%{q}%' OR enname LIKE '%{q}%')
SELECT ts_code, name, fullname, industry, area, market, exchange, list_date, NULL::VARCHAR AS enname FROM a
UNION ALL
SELECT ts_code, name, NULL, NULL, NULL, NULL, NULL, NULL::DATE, enname FROM b WHERE NOT EXISTS (SELECT 1 FROM a)"""

ORACLE = {
    "bars_filtered": """
SELECT * FROM v_daily WHERE ts_code IN ('S1', 'S3', 'S7')
AND trade_date >= DATE '1995-01-01' AND trade_date <= DATE '1996-12-31'""",
    "kline_limited": "SELECT * FROM (" + _adj_sql("qfq") + """)
WHERE time >= DATE '1995-01-01' QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY time) <= 60""",
    "symbol_search_main": _SEARCH.format(q="Supplier#00000000"),
    "reports_latest": """
SELECT * FROM v_report_rc
QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY report_date DESC, report_title) <= 200""",
    "surveys_latest": """
SELECT * FROM v_stk_surv
QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY surv_date DESC, rece_org) <= 100""",
    "rating_class_mixed": """
SELECT CASE rating WHEN '1-URGENT' THEN 'buy' WHEN '2-HIGH' THEN 'buy' WHEN '3-MEDIUM' THEN 'hold'
                   WHEN '4-NOT SPECIFIED' THEN 'sell' ELSE '' END AS rating_class, count(*) AS cnt
FROM v_report_rc GROUP BY 1""",
    "bars": "SELECT * FROM v_daily",
    "close_series": "SELECT ts_code, trade_date, close FROM v_bars",
    "adj_factors": "SELECT * FROM v_adj",
    "kline_qfq": _adj_sql("qfq"),
    "kline_hfq": _adj_sql("hfq"),
    "kline_weekly_qfq": _adj_sql("qfq", "v_weekly"),
    "moving_avg": """
WITH q AS (""" + _adj_sql("qfq").replace("WITH lf AS", "WITH lf2 AS").replace("lf.", "lf2.").replace(
        "JOIN lf ON", "JOIN lf2 ON") + """)
SELECT ts_code, time AS trade_date, close,
""" + ",\n".join(
        f"{_mean('close', n)} AS ma{n}" for n in (5, 10, 20, 60)) + """
FROM q WINDOW w AS (PARTITION BY ts_code ORDER BY time)""",
    "bars_resample": "SELECT * FROM v_weekly",
    "bars_monthly": """
SELECT ts_code, max(trade_date) AS trade_date, arg_min(open, trade_date) AS open, max(high) AS high,
       min(low) AS low, arg_max(close, trade_date) AS close, sum(vol) AS vol,
       CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM v_bars GROUP BY ts_code, date_trunc('month', trade_date)""",
    "bar_flags": """
SELECT b.ts_code, b.trade_date, b.close >= b.open AS is_up, m.total_mv / 1e8 AS total_mv_e8
FROM v_bars b LEFT JOIN v_daily_basic m USING (ts_code, trade_date)""",
    "preview": "SELECT * FROM v_daily ORDER BY ts_code, trade_date LIMIT 20",
    "sql_tables": """
SELECT b.industry, r.broker, count(*) AS picks, max(p.high_water) AS newest
FROM v_recs r JOIN v_stock_basic b ON b.ts_code = r.ts_code
JOIN (SELECT ts_code, max(trade_date) AS high_water FROM v_daily WHERE trade_date < DATE '1998-01-01' GROUP BY ts_code) p
  ON p.ts_code = r.ts_code
WHERE r.month BETWEEN '199601' AND '199612' GROUP BY b.industry, r.broker""",
    "bars_ordered": _position("SELECT * FROM v_daily", "ts_code, trade_date", "open"),
    "adj_factors_ordered": _position("SELECT * FROM v_adj", "ts_code, trade_date", "adj_factor"),
    "metrics_ordered": _position("SELECT ts_code, " + ", ".join(METRIC_COLS) + " FROM v_daily_basic WHERE year(trade_date) = 1996",
                                 "ts_code, trade_date", "close"),
    "surveys_ordered": _position("SELECT * FROM v_stk_surv", "surv_date DESC, ts_code", "rece_org, name, fund_visitors, rece_place"),
    "recs_ordered": _position("SELECT * FROM v_recs", "month DESC, broker, ts_code", "name"),
    "concept_rows_limited": "SELECT * FROM (" + _position("SELECT * FROM v_ths_index WHERE index_code = 'Brand#13'",
                                                          "trade_date DESC, index_code, ts_code", "name") + ") WHERE position <= 300",
    "factors_all": _position("SELECT * FROM (" + _factors_sql() + """)
WHERE ts_code IN ('S1', 'S2') AND trade_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""", "ts_code, trade_date", "close"),
    "sql_param": "SELECT ts_code, trade_date, close FROM v_bars WHERE ts_code = 'S1' AND trade_date >= DATE '1996-01-01'",
    "daily_metrics": "SELECT ts_code, " + ", ".join(METRIC_COLS) + " FROM v_daily_basic",
    "indicator_subset": "SELECT ts_code, " + ", ".join(INDICATOR_COLS) + " FROM (" + _ind_sql() + ")",
    "securities": "SELECT * FROM v_stock_basic WHERE list_status = 'L'",
    "symbols": "SELECT ts_code FROM v_stock_basic",
    "securities_hk_us": _HKUS,
    "security_latest": """
WITH l AS (SELECT ts_code, arg_max(trade_date, trade_date) AS trade_date, arg_max(close, trade_date) AS close,
                  arg_max(pe, trade_date) AS pe, arg_max(pb, trade_date) AS pb,
                  arg_max(turnover_rate, trade_date) AS turnover_rate, arg_max(total_mv, trade_date) AS total_mv
           FROM v_daily_basic GROUP BY ts_code)
SELECT s.ts_code, s.name, s.industry, s.area, s.list_status, l.trade_date, l.close, l.pe, l.pb, l.turnover_rate,
       l.total_mv
FROM v_stock_basic s LEFT JOIN l USING (ts_code)""",
    "symbol_search": _SEARCH.format(q="Customer#0000001"),
    "industry_dist": """
SELECT industry, count(*) AS cnt FROM v_stock_basic WHERE industry IS NOT NULL AND industry <> ''
GROUP BY industry""",
    "industry_top_other": """
WITH d AS (SELECT industry, count(*) AS cnt FROM v_stock_basic WHERE industry IS NOT NULL AND industry <> ''
           GROUP BY industry),
r AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, industry) AS rn FROM d)
SELECT CASE WHEN rn <= 10 THEN industry ELSE 'other' END AS industry, CAST(sum(cnt) AS BIGINT) AS cnt FROM r GROUP BY 1""",
    "reports": "SELECT * FROM v_report_rc WHERE org_name LIKE '%NATION_1%'",
    "eps_trend": """
SELECT ts_code, report_date, org_name, quarter, eps, pe, rating, max_price FROM v_report_rc
WHERE eps IS NOT NULL""",
    "research_orgs": """
SELECT org_name, count(*) AS cnt FROM v_report_rc WHERE org_name IS NOT NULL GROUP BY org_name
ORDER BY cnt DESC, org_name LIMIT 50""",
    "rating_class": """
SELECT CASE WHEN rating IS NULL OR rating = '' THEN ''
            WHEN lower(rating) LIKE '%买入%' OR lower(rating) LIKE '%买%' OR lower(rating) LIKE '%buy%' THEN 'buy'
            WHEN lower(rating) LIKE '%卖出%' OR lower(rating) LIKE '%卖%' OR lower(rating) LIKE '%sell%' THEN 'sell'
            ELSE 'hold' END AS rating_class, count(*) AS cnt
FROM v_report_rc GROUP BY 1""",
    "surveys": "SELECT * FROM v_stk_surv",
    "surveys_with_content": """
SELECT s.*, d.content FROM v_stk_surv s LEFT JOIN v_stk_surv_detail d
ON s.ts_code = d.ts_code AND s.surv_date = d.surv_date AND s.rece_org = d.rece_org""",
    "concept_rows": "SELECT * FROM v_ths_index WHERE index_name LIKE '%Brand#1%'",
    "concepts_of_symbol": "SELECT DISTINCT ts_code, index_code, index_name FROM v_ths_index WHERE index_name IS NOT NULL",
    "concept_daily": """
SELECT DISTINCT index_code, index_name, index_type, trade_date, open, high, low, close, pre_close, pct_chg, vol,
       amount FROM v_ths_index""",
}
