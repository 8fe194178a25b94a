"""Loading the market tables as snapshots: keyed upserts, full lists, exactly-once appends, marks.

Every query loads fresh tables under the shared folder, some batches twice as a restarted loader would,
and returns what a reader of the current version sees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import ingest
from tidemark.session import staging_path
from tidemark.sources.bindings import MarketData
from tidemark.sources.schemas import SPECS, TableSpec
from tidemark.sources.snapshots import SnapshotTable, load_market

REVISED_FROM, STORED_BEFORE = "1997-06-01", "1997-07-01"

EVENT_SPEC = TableSpec("events", T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("day", T.DateType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("value", T.DoubleType()), T.StructField("event_id", T.LongType())]),
    ("event_type", "user_id", "day"), "day", slot="day")


def event_table(spark: SparkSession, root: str) -> SnapshotTable:
    return SnapshotTable(spark, root, EVENT_SPEC)


def _root(md: MarketData) -> str:
    return staging_path(md.spark, "snapshots")


def daily_table(md: MarketData) -> SnapshotTable:
    """The daily table after a first load and a revision (close raised by 1, an unknown column, no ``change``)
    that is loaded twice under its name and once more under another."""
    day = F.col("trade_date")
    root = _root(md)
    stored = md.daily().where(day < F.lit(STORED_BEFORE).cast("date"))
    revised = (md.daily().where(day >= F.lit(REVISED_FROM).cast("date")).withColumn("close", F.col("close") + 1.0)
               .withColumn("vendor_flag", F.lit("x")).drop("change"))
    load_market(md.spark, root, {"daily": stored}, "first")
    for name in ("revision", "revision", "revision again"):
        table = load_market(md.spark, root, {"daily": revised}, name)["daily"]
    return table


def daily_snapshot(md: MarketData) -> DataFrame:
    return daily_table(md).read()


def report_rc_snapshot(md: MarketData) -> DataFrame:
    """Reports (authors may be NULL, a NULL being a key value like any other) loaded twice."""
    root = _root(md)
    load_market(md.spark, root, {"report_rc": md.report_rc()})
    return load_market(md.spark, root, {"report_rc": md.report_rc()})["report_rc"].read()


def stock_basic_snapshot(md: MarketData) -> DataFrame:
    """An older list of securities under other names, with one that the full list lacks, then the full list."""
    root = _root(md)
    full = md.stock_basic()
    gone = md.spark.range(1).select(F.lit("S-GONE").alias("ts_code"), F.lit("left the list").alias("name"))
    older = full.where(F.col("symbol").cast("long") % 2 == 0).withColumn("name", F.lit("older"))
    load_market(md.spark, root, {"stock_basic": older.unionByName(gone, allowMissingColumns=True)})
    return load_market(md.spark, root, {"stock_basic": full})["stock_basic"].read()


def append_replayed(md: MarketData) -> DataFrame:
    """Events appended in two batches, the second replayed: its rows are there once."""
    table = event_table(md.spark, _root(md))
    table.append(ingest.event_base(md), "base")
    for _ in range(2):
        table.append(ingest.event_batch(md), "batch")
    return table.read()


def absent_snapshot(md: MarketData) -> DataFrame:
    """Insert-if-absent into a stored table: stored keys keep their row."""
    table = event_table(md.spark, _root(md))
    table.replace(ingest.event_base(md), ["ts"])
    table.insert_absent(ingest.event_batch(md), ["ts"])
    return table.read()


def high_water_ledger(md: MarketData) -> DataFrame:
    """Marks per symbol, exchange, table and month as they were written with each load (no scan of the rows)."""
    frames = {"daily": md.daily(), "trade_cal": md.trade_cal(), "report_rc": md.report_rc(), "broker_recommend": md.broker_recommend()}
    root = _root(md)
    tables = load_market(md.spark, root, {"daily": md.daily().where(F.col("trade_date") < F.lit(STORED_BEFORE).cast("date"))})
    tables |= load_market(md.spark, root, frames)
    out = None
    for name, table in tables.items():
        marks = table.marks().where("kind <> 'batch'").select(F.lit(name).alias("table_name"), "kind", "key", "mark")
        out = marks if out is None else out.unionByName(marks)
    return out


def bars_pruned(md: MarketData, codes=("S1", "S3"), year: int = 1996) -> DataFrame:
    """Daily rows of some symbols and one year: only the files of that year and key range are opened."""
    root = _root(md)
    return load_market(md.spark, root, {"daily": md.daily()})["daily"].read(codes, f"{year}-01-01", f"{year}-12-31")


QUERIES = {
    "daily_snapshot": daily_snapshot,
    "report_rc_snapshot": report_rc_snapshot,
    "stock_basic_snapshot": stock_basic_snapshot,
    "append_replayed": append_replayed,
    "absent_snapshot": absent_snapshot,
    "high_water_ledger": high_water_ledger,
    "bars_pruned": bars_pruned,
}

_REPORT = SPECS["report_rc"]
_REST = ", ".join(f"{c} DESC NULLS LAST" for c in _REPORT.columns if c not in _REPORT.keys)


def _mark_sql(table: str, view: str, day: str, kind: str | None, key: str | None, fmt: str = "strftime({}, '%Y-%m-%d')") -> str:
    mark = fmt.format(f"max({day})")
    out = f"SELECT '{table}' AS table_name, 'table' AS kind, '{table}' AS key, {mark} AS mark FROM {view} HAVING max({day}) IS NOT NULL"
    return out + (f" UNION ALL SELECT '{table}', '{kind}', {key}, {mark} FROM {view} WHERE {day} IS NOT NULL GROUP BY {key}" if key else "")


ORACLE = {
    "daily_snapshot": f"""
SELECT * REPLACE (CASE WHEN trade_date >= DATE '{REVISED_FROM}' THEN close + 1 ELSE close END AS close,
                  CASE WHEN trade_date >= DATE '{REVISED_FROM}' THEN NULL ELSE change END AS change) FROM v_daily""",
    "report_rc_snapshot": f"""
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(_REPORT.keys)} ORDER BY {_REST}) AS n FROM v_report_rc)
WHERE n = 1""",
    "stock_basic_snapshot": """
SELECT * FROM v_stock_basic UNION ALL
SELECT 'S-GONE', NULL, 'left the list', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""",
    "append_replayed": ingest.ORACLE["append_rows"],
    "absent_snapshot": ingest.ORACLE["insert_absent"],
    "high_water_ledger": " UNION ALL ".join([
        _mark_sql("daily", "v_daily", "trade_date", "symbol", "ts_code"),
        _mark_sql("trade_cal", "v_trade_cal", "cal_date", "exchange", "exchange"),
        _mark_sql("report_rc", "v_report_rc", "report_date", "symbol", "ts_code"),
        _mark_sql("broker_recommend", "v_recs", "month", None, None, "{}")]),
    "bars_pruned": "SELECT * FROM v_daily WHERE ts_code IN ('S1', 'S3') AND year(trade_date) = 1996",
}
