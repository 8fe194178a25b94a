"""Bindings: the driver's TPC-H-like tables viewed as the logical market tables.

Each method returns a lazy DataFrame with exactly the columns of the matching
``TableSpec``. Only the columns a binding needs are read, so Parquet column
pruning and filter pushdown reach the scan. ``code`` of a security is
``'S' || l_suppkey``.

Size notes (for a cluster): ``nation`` (25 rows) and ``region`` (5 rows) are
fixed-size dimensions and are the only tables broadcast by hint. Every other
join is left to the optimizer, which broadcasts only below
``spark.sql.autoBroadcastJoinThreshold`` (checked on statistics and, with AQE,
on the actual shuffle size) and falls back to a sort-merge join above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import as_date, month_of

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed value: the security that plays the role of the market index.
BENCHMARK_CODE = "S0"


def sec_code(col: str = "l_suppkey"):
    return F.concat(F.lit("S"), F.col(col).cast("string"))


def _bar_order():
    """Total order of the lines inside one (symbol, day): ``(orderkey, linenumber,
    partkey, price)`` -- ``(orderkey, linenumber)`` alone is not unique in the data.

    Struct order is exact for every value; a NULL part sorts first.
    """
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def _by_bar(lines: DataFrame) -> DataFrame:
    """Lines shuffled by (symbol, month), as they are, to be aggregated by (symbol, month, day) after the shuffle.

    A bar has hardly more than one line, so a partial aggregate would sort the lines of a scan task only to
    write them again, each wider by two copies of the bar order and a buffer per measure. The bars of a month
    stay together, so that later aggregates over weeks and months combine before their shuffles.
    """
    day = as_date("l_shipdate")
    return (lines.select("*", day.alias("trade_date"), F.trunc(day, "month").alias("__month")).drop("l_shipdate")
            .repartition("l_suppkey", "__month"))


class MarketData:
    """Logical tables over one directory of driver parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    # -- raw ---------------------------------------------------------------
    def table(self, name: str, *cols: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(*cols) if cols else df

    def nation(self) -> DataFrame:
        return F.broadcast(self.table("nation", "n_nationkey", "n_name", "n_regionkey"))

    def region(self) -> DataFrame:
        return F.broadcast(self.table("region", "r_regionkey", "r_name"))

    # -- daily bars ----------------------------------------------------------
    def _daily_agg(self) -> DataFrame:
        li = self.table("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                        "l_quantity", "l_extendedprice", "l_shipdate")
        px, order = F.col("l_extendedprice"), _bar_order()
        agg = _by_bar(li).groupBy("l_suppkey", "__month", "trade_date").agg(
            F.min_by(px, order).alias("open"),
            F.max(px).alias("high"),
            F.min(px).alias("low"),
            F.max_by(px, order).alias("close"),
            F.sum("l_quantity").alias("vol"),
            F.sum(px.cast("decimal(18,2)")).cast("double").alias("amount"),
        )
        # group on the integer key; the symbol string is built once per output row
        return agg.select(sec_code().alias("ts_code"), "trade_date", "open", "high", "low", "close", "vol",
                          "amount")

    def daily(self) -> DataFrame:
        w = Window.partitionBy("ts_code").orderBy("trade_date")
        d = self.bars()
        pre = F.lag("close").over(w)
        return d.select(
            "ts_code", "trade_date", "open", "high", "low", "close",
            pre.alias("pre_close"),
            (F.col("close") - pre).alias("change"),
            F.round(F.try_divide(F.col("close") - pre, F.nullif(pre, F.lit(0.0))) * 100.0, 4).alias("pct_chg"),
            "vol", "amount")

    def bars(self) -> DataFrame:
        """Daily OHLCV without the lag columns (no window in the plan)."""
        return self._daily_agg()

    def adj_factor(self) -> DataFrame:
        li = self.table("lineitem", "l_suppkey", "l_shipdate", "l_discount", "l_returnflag")
        return (li.where(F.col("l_returnflag") == "R")
                .groupBy("l_suppkey", as_date("l_shipdate").alias("trade_date"))
                .agg(F.max(F.lit(1.0) + F.col("l_discount")).alias("adj_factor"))
                .select(sec_code().alias("ts_code"), "trade_date", "adj_factor"))

    def daily_basic(self) -> DataFrame:
        li = self.table("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
        px = F.col("l_extendedprice")
        amount = F.sum(px.cast("decimal(18,2)")).cast("double")
        agg = _by_bar(li).groupBy("l_suppkey", "__month", "trade_date").agg(
            F.max_by(px, _bar_order()).alias("close"),
            F.max("l_discount").alias("turnover_rate"),
            F.max("l_quantity").alias("volume_ratio"),
            F.min("l_quantity").alias("pe"),
            (F.max(px) / 1000.0).alias("pe_ttm"),
            F.max("l_tax").alias("pb"),
            F.min("l_tax").alias("ps"),
            F.min("l_discount").alias("ps_ttm"),
            (F.max("l_tax") - F.min("l_tax")).alias("dv_ratio"),
            amount.alias("total_mv"),
            amount.alias("circ_mv"),
        )
        return agg.select(sec_code().alias("ts_code"), *[c for c in agg.columns if c not in ("l_suppkey", "__month")])

    # -- masters -----------------------------------------------------------
    def stock_basic(self) -> DataFrame:
        s = self.table("supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
        n, r = self.nation(), self.region()
        j = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
        return j.select(
            sec_code("s_suppkey").alias("ts_code"),
            F.col("s_suppkey").cast("string").alias("symbol"),
            F.col("s_name").alias("name"),
            F.concat_ws(" ", "s_name", "r_name").alias("fullname"),
            F.lower(F.regexp_replace("s_name", "#", "")).alias("cnspell"),
            F.col("r_name").alias("area"),
            F.col("n_name").alias("industry"),
            F.when(F.col("s_acctbal") >= 5000, "Main").otherwise("SME").alias("market"),
            F.col("r_name").alias("exchange"),
            F.when(F.col("s_acctbal") < 0, "D").otherwise("L").alias("list_status"),
            F.lit(None).cast("date").alias("list_date"),
        )

    def hk_basic(self) -> DataFrame:
        """Second-market master from customers (its own extra columns)."""
        c = self.table("customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal")
        pad = F.col("c_custkey").cast("string")
        return c.select(
            F.concat(F.when(F.length(pad) < 5, F.lpad(pad, 5, "0")).otherwise(pad), F.lit(".HK")).alias("ts_code"),
            F.col("c_name").alias("name"),
            F.upper("c_mktsegment").alias("enname"),
            F.col("c_mktsegment").alias("classify"),
            F.col("c_acctbal").alias("acct"))

    def us_basic(self) -> DataFrame:
        """Third-market master from suppliers (different extra columns)."""
        s = self.table("supplier", "s_suppkey", "s_name", "s_acctbal")
        return s.select(
            F.concat(F.lit("U"), F.col("s_suppkey").cast("string"), F.lit(".US")).alias("ts_code"),
            F.col("s_name").alias("name"),
            F.lower("s_name").alias("enname"),
            F.lit(None).cast("date").alias("list_date"),
            F.col("s_acctbal").alias("industry_score"))

    # -- calendar ------------------------------------------------------------
    def ship_date_bounds(self):
        li = self.table("lineitem", "l_shipdate")
        lo = li.select(F.min(as_date("l_shipdate"))).scalar()
        hi = li.select(F.max(as_date("l_shipdate"))).scalar()
        return lo, hi

    def trade_cal(self) -> DataFrame:
        """Every day from the first to the last ship date, per exchange (region).

        The two bounds are scalar subqueries, so the day spine is generated per
        region row with ``sequence`` (no cross join). Per exchange it holds one
        row per calendar day, so its size is bounded by the calendar, not by data.
        """
        lo, hi = self.ship_date_bounds()
        days = self.region().select(F.col("r_name").alias("exchange"),
                                    F.explode(F.sequence(lo, hi)).alias("cal_date"))
        is_open = F.weekday("cal_date") < 5
        w = Window.partitionBy("exchange").orderBy("cal_date").rowsBetween(Window.unboundedPreceding, -1)
        return days.select("exchange", "cal_date", is_open.alias("is_open"),
                           F.max(F.when(is_open, F.col("cal_date"))).over(w).alias("pretrade_date"))

    # -- research / recommendations -------------------------------------------
    def _order_lines(self) -> DataFrame:
        o = self.table("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
        c = self.table("customer", "c_custkey", "c_name", "c_nationkey")
        n = self.nation()
        return (o.join(c, o.o_custkey == c.c_custkey)
                .join(n, c.c_nationkey == n.n_nationkey))

    def broker_recommend(self) -> DataFrame:
        li = self.table("lineitem", "l_orderkey", "l_suppkey")
        picks = (li.join(self._order_lines(), li.l_orderkey == F.col("o_orderkey"))
                 .select(month_of("o_orderdate").alias("month"), F.col("n_name").alias("broker"),
                         F.col("l_suppkey"))
                 .distinct())
        s = self.table("supplier", "s_suppkey", "s_name")
        return (picks.join(s, picks.l_suppkey == s.s_suppkey, "left")
                .select("month", "broker", sec_code().alias("ts_code"), F.col("s_name").alias("name")))

    def report_rc(self) -> DataFrame:
        li = self.table("lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity",
                        "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus")
        j = li.join(self._order_lines(), li.l_orderkey == F.col("o_orderkey"))
        return j.select(
            sec_code().alias("ts_code"),
            as_date("o_orderdate").alias("report_date"),
            F.concat(F.lit("R"), F.col("o_orderkey").cast("string"), F.lit("-"),
                     F.col("l_linenumber").cast("string")).alias("report_title"),
            F.col("l_linestatus").alias("report_type"),
            F.col("n_name").alias("org_name"),
            F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string")).otherwise(F.col("c_name"))
            .alias("author_name"),
            F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"),
                     F.quarter("o_orderdate").cast("string")).alias("quarter"),
            F.when(F.col("l_returnflag") == "N", F.lit(None).cast("double")).otherwise(F.col("l_quantity"))
            .alias("eps"),
            (F.col("l_tax") * 100.0).alias("pe"),
            F.col("o_orderpriority").alias("rating"),
            F.col("l_extendedprice").alias("max_price"),
        )

    # -- surveys -------------------------------------------------------------
    def survey_raw(self) -> DataFrame:
        """Survey batch with the large ``content`` column (from ``documents``)."""
        d = self.table("documents", "doc_id", "text", "lang", "source")
        content = (F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string"))
                   .when(F.col("doc_id") % 11 == 0, F.lit(""))
                   .otherwise(F.col("text")))
        return d.select(
            F.col("source").alias("ts_code"),
            F.upper("source").alias("name"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")).alias("surv_date"),
            F.col("lang").alias("fund_visitors"),
            F.concat(F.lit("room-"), F.col("lang")).alias("rece_place"),
            F.lit("meeting").alias("rece_mode"),
            F.concat(F.lit("ORG"), F.col("doc_id").cast("string")).alias("rece_org"),
            F.col("lang").alias("org_type"),
            F.col("source").alias("comp_rece"),
            content.alias("content"),
        )

    def stk_surv(self) -> DataFrame:
        return self.survey_raw().drop("content")

    def stk_surv_detail(self) -> DataFrame:
        from tidemark.operators.ingest import split_detail
        return split_detail(self.survey_raw(), ["ts_code", "surv_date", "rece_org"], "content")[1]

    # -- concepts ------------------------------------------------------------
    def concept_quotes(self) -> DataFrame:
        li = self.table("lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                        "l_extendedprice", "l_shipdate")
        p = self.table("part", "p_partkey", "p_brand")
        px, order = F.col("l_extendedprice"), _bar_order()
        q = (li.join(p, li.l_partkey == p.p_partkey)
             .groupBy(F.col("p_brand").alias("index_code"), as_date("l_shipdate").alias("trade_date"))
             .agg(F.min_by(px, order).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"),
                  F.max_by(px, order).alias("close"), F.sum("l_quantity").alias("vol"),
                  F.sum(px.cast("decimal(18,2)")).cast("double").alias("amount")))
        w = Window.partitionBy("index_code").orderBy("trade_date")
        pre = F.lag("close").over(w)
        return q.select("index_code", "trade_date", "open", "high", "low", "close", pre.alias("pre_close"),
                        F.round(F.try_divide(F.col("close") - pre, F.nullif(pre, F.lit(0.0))) * 100.0, 4)
                        .alias("pct_chg"), "vol", "amount")

    def concept_members(self) -> DataFrame:
        p = self.table("part", "p_partkey", "p_brand", "p_name")
        return p.select(F.col("p_brand").alias("index_code"),
                        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ts_code"),
                        F.col("p_name").alias("name"))

    def concept_meta(self) -> DataFrame:
        p = self.table("part", "p_brand", "p_type")
        return p.groupBy(F.col("p_brand").alias("index_code")).agg(
            F.concat(F.lit("Concept "), F.min("p_brand")).alias("index_name"),
            F.min("p_type").alias("index_type"))

    def ths_index(self) -> DataFrame:
        from tidemark.operators.ingest import concept_denorm
        return concept_denorm(self.concept_quotes(), self.concept_members(), self.concept_meta())

    # -- derived time series ---------------------------------------------------
    def weekly(self) -> DataFrame:
        from tidemark.operators.bars import resample
        return resample(self.bars(), "week")

    def stk_factor_pro(self, columns=None) -> DataFrame:
        """All columns or the given ones, never stored: a query pays for the columns that it reads."""
        from tidemark.operators.bars import wide_factors
        from tidemark.sources.schemas import FACTOR_COLS
        return wide_factors(self.daily(), self.adj_factor(), self.daily_basic(), columns or FACTOR_COLS)

    # -- watchlist / events -----------------------------------------------------
    def watchlist_input(self) -> DataFrame:
        """(code, market, tag) rows from customers; tag = nation name."""
        c = self.table("customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
        n = self.nation()
        key6 = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
        market = (F.when(F.col("c_mktsegment") == "MACHINERY", "SH")
                  .when(F.col("c_mktsegment") == "BUILDING", "sz")
                  .when(F.col("c_mktsegment") == "AUTOMOBILE", "177")
                  .when(F.col("c_mktsegment") == "FURNITURE", "CYB")
                  .otherwise("120"))
        code = (F.when(market == "177", F.concat(F.lit("HK"), F.col("c_custkey").cast("string")))
                .otherwise(F.concat(F.when(F.col("c_acctbal") >= 0, "300").otherwise("688"),
                                    F.substring(key6, -3, 3))))
        return (c.join(n, c.c_nationkey == n.n_nationkey)
                .select(code.alias("code"), market.alias("market"), F.col("n_name").alias("tag")))

    def event_days(self) -> DataFrame:
        """Coverage input: (user_id, day) present in ``events``."""
        e = self.table("events", "user_id", "ts")
        return e.select("user_id", as_date("ts").alias("day")).distinct()
