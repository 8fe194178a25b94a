"""Ingest and keyed-write queries over the driver tables.

The upsert family uses ``events`` as the keyed time series: key
``(user_id, event_type, day)``, the latest ``ts`` wins; the base holds the rows
before 2024-01-16 and the incoming batch the rows from 2024-01-14 on, so the
two overlap for two days and the batch carries repeated keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import as_date
from tidemark.operators.ingest import concept_denorm, parse_batch, split_detail, union_ragged
from tidemark.operators.merge import align_schema, append_rows, insert_absent, latest_per_key, upsert_merge
from tidemark.sources.bindings import MarketData
from tidemark.sources.schemas import spec

EVENT_KEYS = ["user_id", "event_type", "day"]
BASE_BEFORE = "2024-01-16"
BATCH_FROM = "2024-01-14"


def event_rows(md: MarketData) -> DataFrame:
    e = md.table("events", "event_id", "ts", "user_id", "event_type", "value")
    return e.select("user_id", "event_type", as_date("ts").alias("day"), "ts", "value", "event_id")


def event_base(md: MarketData) -> DataFrame:
    """The stored table: one row per key (latest ts) from the rows before the cut."""
    rows = event_rows(md).where(F.col("ts") < F.lit(BASE_BEFORE).cast("timestamp_ntz"))
    return latest_per_key(rows, EVENT_KEYS, ["ts"])


def event_batch(md: MarketData) -> DataFrame:
    return event_rows(md).where(F.col("ts") >= F.lit(BATCH_FROM).cast("timestamp_ntz"))


def upsert_merge_q(md: MarketData) -> DataFrame:
    """Upsert the batch into the base: new keys inserted, existing keys replaced."""
    return upsert_merge(event_base(md), event_batch(md), EVENT_KEYS, ["ts"])


def insert_absent_q(md: MarketData) -> DataFrame:
    """Insert-if-absent: keys already in the base keep their base row."""
    return insert_absent(event_base(md), latest_per_key(event_batch(md), EVENT_KEYS, ["ts"]), EVENT_KEYS)


def append_rows_q(md: MarketData) -> DataFrame:
    return append_rows(event_base(md), event_batch(md))


def latest_per_key_q(md: MarketData) -> DataFrame:
    """Latest event per (user, event type)."""
    return latest_per_key(event_rows(md).drop("day"), ["user_id", "event_type"], ["ts"])


def parse_dates_input(md: MarketData) -> DataFrame:
    """Vendor-style strings from ``orders``: ``YYYYMMDD``, ``YYYY-MM-DD``, invalid
    (month 13) or empty, plus a 0/1 weekday flag."""
    o = md.table("orders", "o_orderkey", "o_orderdate")
    k = F.col("o_orderkey") % 4
    s = (F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd"))
         .when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
         .when(k == 2, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("13"), F.date_format("o_orderdate", "dd")))
         .otherwise(F.lit("")))
    return o.select("o_orderkey", s.alias("raw_date"),
                    F.when(F.weekday("o_orderdate") < 5, 1).otherwise(0).alias("is_open"))


def parse_dates_q(md: MarketData) -> DataFrame:
    return parse_batch(parse_dates_input(md).withColumn("trade_date", F.col("raw_date")),
                       date_cols=["trade_date"], bool_cols=["is_open"])


def parse_dates_strict_q(md: MarketData) -> DataFrame:
    """Strict parse: only valid strings (an invalid one raises)."""
    d = parse_dates_input(md).where((F.col("o_orderkey") % 4) < 2)
    return parse_batch(d.withColumn("trade_date", F.col("raw_date")), date_cols=["trade_date"], strict=True)


def align_schema_q(md: MarketData) -> DataFrame:
    """A second-market batch projected onto the main security schema: its unknown
    columns dropped, the missing ones NULL."""
    aligned, _dropped = align_schema(md.hk_basic(), spec("stock_basic").schema)
    return aligned


def union_ragged_q(md: MarketData) -> DataFrame:
    return union_ragged([md.hk_basic(), md.us_basic()])


def security_master_union(md: MarketData) -> DataFrame:
    from tidemark.plans.market import hk_us_master
    return hk_us_master(md)


def split_detail_q(md: MarketData) -> DataFrame:
    return split_detail(md.survey_raw(), ["ts_code", "surv_date", "rece_org"], "content")[1]


def concept_denorm_q(md: MarketData) -> DataFrame:
    return md.ths_index()


def concept_denorm_left(md: MarketData) -> DataFrame:
    """Quotes with the name lookup when no member list arrived: member columns NULL."""
    return concept_denorm(md.concept_quotes(), None, md.concept_meta())


QUERIES = {
    "upsert_merge": upsert_merge_q,
    "insert_absent": insert_absent_q,
    "append_rows": append_rows_q,
    "latest_per_key": latest_per_key_q,
    "parse_dates": parse_dates_q,
    "parse_dates_strict": parse_dates_strict_q,
    "align_schema": align_schema_q,
    "union_ragged": union_ragged_q,
    "security_master_union": security_master_union,
    "split_detail": split_detail_q,
    "concept_denorm": concept_denorm_q,
    "concept_denorm_left": concept_denorm_left,
}

_ROWS = """
SELECT user_id, event_type, CAST(ts AS DATE) AS day, ts, value, event_id FROM events"""
_BASE = f"""
SELECT user_id, event_type, day, arg_max(ts, (ts, value, event_id)) AS ts,
       arg_max(value, (ts, value, event_id)) AS value, arg_max(event_id, (ts, value, event_id)) AS event_id
FROM ({_ROWS}) WHERE ts < TIMESTAMP '{BASE_BEFORE}' GROUP BY user_id, event_type, day"""
_BATCH = f"SELECT * FROM ({_ROWS}) WHERE ts >= TIMESTAMP '{BATCH_FROM}'"
_BATCH_LATEST = f"""
SELECT user_id, event_type, day, arg_max(ts, (ts, value, event_id)) AS ts,
       arg_max(value, (ts, value, event_id)) AS value, arg_max(event_id, (ts, value, event_id)) AS event_id
FROM ({_BATCH}) GROUP BY user_id, event_type, day"""
_PARSE_IN = """
SELECT o_orderkey,
       CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN 2 THEN strftime(o_orderdate, '%Y') || '13' || strftime(o_orderdate, '%d') ELSE '' END AS raw_date,
       CASE WHEN isodow(o_orderdate) <= 5 THEN 1 ELSE 0 END AS is_open
FROM orders"""

ORACLE = {
    "upsert_merge": f"""
SELECT user_id, event_type, day, arg_max(ts, (prio, ts, value, event_id)) AS ts,
       arg_max(value, (prio, ts, value, event_id)) AS value, arg_max(event_id, (prio, ts, value, event_id)) AS event_id
FROM (SELECT *, 0 AS prio FROM ({_BASE}) UNION ALL SELECT *, 1 AS prio FROM ({_BATCH}))
GROUP BY user_id, event_type, day""",
    "insert_absent": f"""
SELECT * FROM ({_BASE}) UNION ALL
SELECT * FROM ({_BATCH_LATEST}) n WHERE NOT EXISTS (
  SELECT 1 FROM ({_BASE}) b WHERE b.user_id IS NOT DISTINCT FROM n.user_id
  AND b.event_type IS NOT DISTINCT FROM n.event_type AND b.day IS NOT DISTINCT FROM n.day)""",
    "append_rows": f"SELECT * FROM ({_BASE}) UNION ALL SELECT * FROM ({_BATCH})",
    "latest_per_key": """
SELECT user_id, event_type, arg_max(ts, (ts, value, event_id)) AS ts, arg_max(value, (ts, value, event_id)) AS value,
       arg_max(event_id, (ts, value, event_id)) AS event_id FROM events GROUP BY user_id, event_type""",
    "parse_dates": f"""
SELECT o_orderkey, raw_date, CAST(is_open AS BOOLEAN) AS is_open,
       CASE WHEN length(replace(trim(raw_date), '-', '')) = 8
            THEN CAST(try_strptime(replace(trim(raw_date), '-', ''), '%Y%m%d') AS DATE) END AS trade_date
FROM ({_PARSE_IN})""",
    "parse_dates_strict": f"""
SELECT o_orderkey, raw_date, is_open, CAST(strptime(replace(raw_date, '-', ''), '%Y%m%d') AS DATE) AS trade_date
FROM ({_PARSE_IN}) WHERE o_orderkey % 4 < 2""",
    "align_schema": """
SELECT ts_code, NULL::VARCHAR AS symbol, name, NULL::VARCHAR AS fullname, NULL::VARCHAR AS cnspell,
       NULL::VARCHAR AS area, NULL::VARCHAR AS industry, NULL::VARCHAR AS market, NULL::VARCHAR AS exchange,
       NULL::VARCHAR AS list_status, NULL::DATE AS list_date FROM v_hk_basic""",
    "union_ragged": """
SELECT ts_code, name, enname, classify, acct, NULL::DATE AS list_date, NULL::DOUBLE AS industry_score
FROM v_hk_basic UNION ALL
SELECT ts_code, name, enname, NULL, NULL, list_date, industry_score FROM v_us_basic""",
    "security_master_union": """
SELECT ts_code, arg_max(name, (name, enname)) AS name, arg_max(enname, (name, enname)) AS enname
FROM (SELECT ts_code, name, enname FROM v_hk_basic UNION ALL SELECT ts_code, name, enname FROM v_us_basic)
GROUP BY ts_code""",
    "split_detail": "SELECT * FROM v_stk_surv_detail",
    "concept_denorm": "SELECT * FROM v_ths_index",
    "concept_denorm_left": """
SELECT q.index_code, coalesce(m.index_name, '') AS index_name, coalesce(m.index_type, '') AS index_type,
       q.trade_date, q.open, q.high, q.low, q.close, q.pre_close, q.pct_chg, q.vol, q.amount,
       NULL::VARCHAR AS ts_code, NULL::VARCHAR AS name
FROM v_concept_quotes q LEFT JOIN v_concept_meta m ON q.index_code = m.index_code""",
}
