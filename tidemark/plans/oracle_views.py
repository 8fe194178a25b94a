"""The logical-table bindings written as DuckDB SQL (for the oracle check only).

Each view mirrors the Spark binding in ``tidemark.sources.bindings`` so the
driver can run our query and an independent SQL formulation side by side on
the same parquet files. ``with_views(sql)`` prepends the CTEs that ``sql``
mentions, in dependency order.
"""

from __future__ import annotations

import re

CODE = "'S' || CAST(l_suppkey AS VARCHAR)"
BAR_ORDER = "(l_orderkey, l_linenumber, l_partkey, l_extendedprice)"

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "v_bars": (f"""
SELECT {CODE} AS ts_code, CAST(l_shipdate AS DATE) AS trade_date,
       arg_min(l_extendedprice, {BAR_ORDER}) AS open, max(l_extendedprice) AS high,
       min(l_extendedprice) AS low, arg_max(l_extendedprice, {BAR_ORDER}) AS close,
       sum(l_quantity) AS vol,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM lineitem GROUP BY ALL""", ()),
    "v_daily": ("""
SELECT ts_code, trade_date, open, high, low, close,
       lag(close) OVER w AS pre_close, close - lag(close) OVER w AS change,
       round((close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) * 100, 4) AS pct_chg, vol, amount
FROM v_bars WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)""", ("v_bars",)),
    "v_adj": (f"""
SELECT {CODE} AS ts_code, CAST(l_shipdate AS DATE) AS trade_date, max(1 + l_discount) AS adj_factor
FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL""", ()),
    "v_daily_basic": (f"""
SELECT {CODE} AS ts_code, CAST(l_shipdate AS DATE) AS trade_date,
       arg_max(l_extendedprice, {BAR_ORDER}) AS close, max(l_discount) AS turnover_rate,
       max(l_quantity) AS volume_ratio, min(l_quantity) AS pe, max(l_extendedprice) / 1000.0 AS pe_ttm,
       max(l_tax) AS pb, min(l_tax) AS ps, min(l_discount) AS ps_ttm, max(l_tax) - min(l_tax) AS dv_ratio,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_mv,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS circ_mv
FROM lineitem GROUP BY ALL""", ()),
    "v_order_lines": ("""
SELECT o.o_orderkey, o.o_orderdate, o.o_orderstatus, o.o_orderpriority, c.c_name, n.n_name
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""", ()),
    "v_recs": ("""
SELECT p.month, p.broker, 'S' || CAST(p.l_suppkey AS VARCHAR) AS ts_code, s.s_name AS name
FROM (SELECT DISTINCT strftime(ol.o_orderdate, '%Y%m') AS month, ol.n_name AS broker, l.l_suppkey
      FROM lineitem l JOIN v_order_lines ol ON l.l_orderkey = ol.o_orderkey) p
LEFT JOIN supplier s ON p.l_suppkey = s.s_suppkey""", ("v_order_lines",)),
    "v_stock_basic": ("""
SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS ts_code, CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS name,
       concat_ws(' ', s_name, r_name) AS fullname, lower(replace(s_name, '#', '')) AS cnspell,
       r_name AS area, n_name AS industry, CASE WHEN s_acctbal >= 5000 THEN 'Main' ELSE 'SME' END AS market,
       r_name AS exchange, CASE WHEN s_acctbal < 0 THEN 'D' ELSE 'L' END AS list_status,
       CAST(NULL AS DATE) AS list_date
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""", ()),
    "v_hk_basic": ("""
SELECT CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 5 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0')
            ELSE CAST(c_custkey AS VARCHAR) END || '.HK' AS ts_code,
       c_name AS name, upper(c_mktsegment) AS enname, c_mktsegment AS classify, c_acctbal AS acct
FROM customer""", ()),
    "v_us_basic": ("""
SELECT 'U' || CAST(s_suppkey AS VARCHAR) || '.US' AS ts_code, s_name AS name, lower(s_name) AS enname,
       CAST(NULL AS DATE) AS list_date, s_acctbal AS industry_score
FROM supplier""", ()),
    "v_trade_cal": ("""
SELECT exchange, cal_date, is_open,
       max(CASE WHEN is_open THEN cal_date END) OVER (PARTITION BY exchange ORDER BY cal_date
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pretrade_date
FROM (SELECT r_name AS exchange, CAST(d AS DATE) AS cal_date, isodow(d) <= 5 AS is_open
      FROM region, generate_series((SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem),
                                   (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem), INTERVAL 1 DAY) t(d))""",
                    ()),
    "v_report_rc": ("""
SELECT 'S' || CAST(l.l_suppkey AS VARCHAR) AS ts_code, CAST(ol.o_orderdate AS DATE) AS report_date,
       'R' || CAST(ol.o_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS report_title,
       l.l_linestatus AS report_type, ol.n_name AS org_name,
       CASE WHEN ol.o_orderstatus = 'P' THEN NULL ELSE ol.c_name END AS author_name,
       CAST(year(ol.o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(ol.o_orderdate) AS VARCHAR) AS quarter,
       CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE l.l_quantity END AS eps,
       l.l_tax * 100.0 AS pe, ol.o_orderpriority AS rating, l.l_extendedprice AS max_price
FROM lineitem l JOIN v_order_lines ol ON l.l_orderkey = ol.o_orderkey""", ("v_order_lines",)),
    "v_survey_raw": ("""
SELECT source AS ts_code, upper(source) AS name,
       CAST(DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER) AS DATE) AS surv_date,
       lang AS fund_visitors, 'room-' || lang AS rece_place, 'meeting' AS rece_mode,
       'ORG' || CAST(doc_id AS VARCHAR) AS rece_org, lang AS org_type, source AS comp_rece,
       CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '' ELSE text END AS content
FROM documents""", ()),
    "v_stk_surv": ("""
SELECT * EXCLUDE (content) FROM v_survey_raw""", ("v_survey_raw",)),
    "v_stk_surv_detail": ("""
SELECT ts_code, surv_date, rece_org, content FROM v_survey_raw
WHERE content IS NOT NULL AND content <> ''""", ("v_survey_raw",)),
    "v_concept_quotes": ("""
SELECT index_code, trade_date, open, high, low, close, lag(close) OVER w AS pre_close,
       round((close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) * 100, 4) AS pct_chg, vol, amount
FROM (SELECT p.p_brand AS index_code, CAST(l.l_shipdate AS DATE) AS trade_date,
             arg_min(l.l_extendedprice, (l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice)) AS open,
             max(l.l_extendedprice) AS high, min(l.l_extendedprice) AS low,
             arg_max(l.l_extendedprice, (l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice)) AS close,
             sum(l.l_quantity) AS vol, CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY ALL)
WINDOW w AS (PARTITION BY index_code ORDER BY trade_date)""", ()),
    "v_concept_members": ("""
SELECT p_brand AS index_code, 'P' || CAST(p_partkey AS VARCHAR) AS ts_code, p_name AS name FROM part""", ()),
    "v_concept_meta": ("""
SELECT p_brand AS index_code, 'Concept ' || min(p_brand) AS index_name, min(p_type) AS index_type
FROM part GROUP BY p_brand""", ()),
    "v_ths_index": ("""
SELECT q.index_code, coalesce(m.index_name, '') AS index_name, coalesce(m.index_type, '') AS index_type,
       q.trade_date, q.open, q.high, q.low, q.close, q.pre_close, q.pct_chg, q.vol, q.amount,
       mb.ts_code, mb.name
FROM v_concept_quotes q JOIN v_concept_members mb ON q.index_code = mb.index_code
LEFT JOIN v_concept_meta m ON q.index_code = m.index_code""",
                    ("v_concept_quotes", "v_concept_members", "v_concept_meta")),
    "v_weekly": ("""
SELECT ts_code, max(trade_date) AS trade_date, arg_min(open, trade_date) AS open, max(high) AS high,
       min(low) AS low, arg_max(close, trade_date) AS close, sum(vol) AS vol,
       CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM v_bars GROUP BY ts_code, date_trunc('week', trade_date)""", ("v_bars",)),
    "v_watch_in": ("""
SELECT CASE WHEN mk = '177' THEN 'HK' || CAST(c_custkey AS VARCHAR)
            ELSE (CASE WHEN c_acctbal >= 0 THEN '300' ELSE '688' END)
                 || right(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), 3) END AS code,
       mk AS market, n_name AS tag
FROM (SELECT *, CASE c_mktsegment WHEN 'MACHINERY' THEN 'SH' WHEN 'BUILDING' THEN 'sz'
                     WHEN 'AUTOMOBILE' THEN '177' WHEN 'FURNITURE' THEN 'CYB' ELSE '120' END AS mk
      FROM customer) c JOIN nation n ON c.c_nationkey = n.n_nationkey""", ()),
    "v_event_days": ("""
SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events""", ()),
}


def _deps(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in VIEWS[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every ``v_*`` view it references."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql.strip()
    order = _deps(used)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][0].strip()})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def req_returns_view(horizons=(1,)) -> str:
    """SQL for per-(ts_code, month) first close and k-month last closes (ASOF joins)."""
    cols = ", ".join(f"l{k}.close AS lc{k}" for k in horizons)
    joins = "\n".join(
        f"ASOF LEFT JOIN v_bars l{k} ON r.ts_code = l{k}.ts_code "
        f"AND CAST(r.ms + INTERVAL {k} MONTH AS DATE) > l{k}.trade_date" for k in horizons)
    return f"""
SELECT r.ts_code, r.month, f.trade_date AS first_date, f.close AS fc, {cols}
FROM (SELECT DISTINCT ts_code, month, CAST(strptime(month || '01', '%Y%m%d') AS DATE) AS ms FROM v_recs) r
ASOF LEFT JOIN v_bars f ON r.ts_code = f.ts_code AND r.ms <= f.trade_date
{joins}"""


VIEWS["v_ret"] = (req_returns_view((1,)), ("v_bars", "v_recs"))
VIEWS["v_ret136"] = (req_returns_view((1, 3, 6)), ("v_bars", "v_recs"))
VIEWS["v_pick_ret"] = ("""
SELECT ts_code, month, fc AS first_close, lc1 AS last_close, (lc1 - fc) / nullif(fc, 0) * 100 AS ret
FROM v_ret WHERE fc IS NOT NULL AND lc1 IS NOT NULL""", ("v_ret",))
