"""Landing directories and file sinks.

The source application pages through a vendor API and concatenates pages;
here a batch arrives as files in a landing directory and is read with a
declared schema (no inference), one Spark partition per file split. Reading
"many dates in parallel" becomes a partitioned landing layout
(``trade_date=…`` directories) plus a partition filter, which Spark prunes at
planning time or, for a semi-join with a date table, at run time (dynamic
partition pruning).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import nan_to_null


def write_landing(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> str:
    """``partition_by``: one folder per value, filled by the tasks of that value alone (few files, not one
    per task and value)."""
    w = (df.repartition(partition_by) if partition_by else df).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def read_landing(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read a landing directory with a declared schema (no schema inference)."""
    r = spark.read.schema(schema)
    if fmt == "csv":
        return r.option("header", True).option("mode", "FAILFAST").csv(path)
    if fmt == "json":
        return r.json(path)
    return r.parquet(path)


def read_landing_dates(spark: SparkSession, path: str, schema: T.StructType, dates: DataFrame,
                       date_col: str = "trade_date", month_col: str = "trade_month") -> DataFrame:
    """Read only the days listed in ``dates`` (a one-column DataFrame) from a landing
    directory partitioned by ``month_col`` (``yyyyMM``).

    The date table is a calendar subset, bounded by the calendar span, so it is
    broadcast. The semi-join on the month partition column lets dynamic
    partition pruning skip the other directories; the one on the day keeps
    exactly the requested days."""
    df = read_landing(spark, path, schema)
    d = F.broadcast(dates.select(F.col(date_col)).distinct())
    months = F.broadcast(dates.select(F.date_format(date_col, "yyyyMM").alias(month_col)).distinct())
    return df.join(months, month_col, "left_semi").join(d, date_col, "left_semi")


def export_csv(df: DataFrame, path: str) -> str:
    """CSV with a header row, one file per partition (written by the executors)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row: NaN -> null, dates as ISO strings, NULL fields kept."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd" if isinstance(f.dataType, T.DateType) else "yyyy-MM-dd'T'HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("record"))
