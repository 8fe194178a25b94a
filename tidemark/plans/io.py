"""Sources, sinks and the streaming upsert, as registered queries.

Each query stages its input under the shared checkpoint folder (a fresh path
per call) from the driver tables, then reads it back the way a landing batch
is read; the returned DataFrame is the read side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import landing as L
from tidemark.sources.bindings import MarketData
from tidemark.session import staging_path

BAR_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("ts_code", T.StringType()), ("trade_date", T.DateType()), ("open", T.DoubleType()), ("high", T.DoubleType()),
    ("low", T.DoubleType()), ("close", T.DoubleType()), ("vol", T.DoubleType()), ("amount", T.DoubleType())]])


def landing_read(md: MarketData) -> DataFrame:
    """Bars landed as CSV files, read back with the declared schema."""
    path = staging_path(md.spark, "landing-csv")
    L.write_landing(md.bars(), path, "csv")
    return L.read_landing(md.spark, path, BAR_SCHEMA, "csv")


def landing_read_dates(md: MarketData, year: int = 1996) -> DataFrame:
    """Bars landed in ``trade_month=`` partitions; only the open days of ``year`` are read
    (month partitions pruned, then the exact days)."""
    path = staging_path(md.spark, "landing-by-month")
    L.write_landing(md.bars().withColumn("trade_month", F.date_format("trade_date", "yyyyMM")), path, "parquet",
                    partition_by="trade_month")
    days = (md.trade_cal().where((F.col("exchange") == "ASIA") & F.col("is_open") &
                                 (F.year("cal_date") == year))
            .select(F.col("cal_date").alias("trade_date")))
    schema = T.StructType(BAR_SCHEMA.fields + [T.StructField("trade_month", T.StringType())])
    return L.read_landing_dates(md.spark, path, schema, days).drop("trade_month")


def export_csv(md: MarketData) -> DataFrame:
    """The weekly table exported as CSV with a header; returns the file contents."""
    path = staging_path(md.spark, "export")
    L.export_csv(md.weekly(), path)
    return L.read_landing(md.spark, path, BAR_SCHEMA, "csv")


def json_records(md: MarketData) -> DataFrame:
    """The top stocks as JSON text, with a share that is NaN where a stock has a single pick."""
    from tidemark.plans.picks import top_stocks
    share = F.when(F.col("rec_cnt") == 1, F.lit(float("nan"))).otherwise(F.col("broker_cnt") / F.col("rec_cnt"))
    return L.json_records(top_stocks(md).withColumn("broker_share", share))


def stream_upsert(md: MarketData) -> DataFrame:
    """The event batch landed as files (twice, as a replay would), streamed through
    foreachBatch upsert into the stored table."""
    from tidemark.plans.ingest import EVENT_KEYS, event_base, event_batch
    from tidemark.plans.loading import event_table
    from tidemark.streaming.upsert_stream import start_upsert_stream

    spark = md.spark
    # a micro-batch opens only the days that it touches
    target = event_table(spark, staging_path(spark, "stream-target"))
    target.replace(event_base(md), ["ts"])
    landing = staging_path(spark, "stream-landing")
    batch = event_batch(md)
    batch.write.mode("overwrite").parquet(landing)
    batch.write.mode("append").parquet(landing)  # replayed files
    q = start_upsert_stream(spark, landing, batch.schema, target, EVENT_KEYS, ["ts"])
    q.awaitTermination()
    return target.read()


QUERIES = {
    "landing_read": landing_read,
    "landing_read_dates": landing_read_dates,
    "export_csv": export_csv,
    "json_records": json_records,
    "stream_upsert": stream_upsert,
}

def _upsert_oracle() -> str:
    from tidemark.plans.ingest import ORACLE as INGEST_ORACLE
    return INGEST_ORACLE["upsert_merge"]


def _json_oracle() -> str:
    from tidemark.plans.picks import ORACLE as PICKS_ORACLE
    cols = ["month", "rank", "ts_code", "name", "rec_cnt", "broker_cnt", "is_hot", "month_return", "first_close", "last_close"]
    fields = ", ".join(f"{c} := {c}" for c in cols)
    return (f"SELECT CAST(to_json(struct_pack({fields}, broker_share := CASE WHEN rec_cnt > 1 THEN broker_cnt / rec_cnt END)) AS VARCHAR) "
            f"AS record FROM ({PICKS_ORACLE['top_stocks']})")


ORACLE = {
    "json_records": _json_oracle(),
    "stream_upsert": _upsert_oracle(),
    "landing_read": "SELECT ts_code, trade_date, open, high, low, close, vol, amount FROM v_bars",
    "landing_read_dates": """
SELECT ts_code, trade_date, open, high, low, close, vol, amount FROM v_bars
WHERE trade_date IN (SELECT cal_date FROM v_trade_cal WHERE exchange = 'ASIA' AND is_open AND year(cal_date) = 1996)""",
    "export_csv": "SELECT ts_code, trade_date, open, high, low, close, vol, amount FROM v_weekly",
}
