"""Recommendation analytics: every broker, symbol and month in one plan.

The source application answers these one month / one broker at a time with
a query per row. Here each query is a single DataFrame over all months:
recommendations -> as-of month closes (``month_closes``) -> aggregation.
Returns are ``(last - first) / nullif(first, 0) * 100``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import pct_change, safe_ratio_pct
from tidemark.operators.asof import month_closes
from tidemark.sources.bindings import BENCHMARK_CODE, MarketData

# Consensus bins by number of distinct brokers.
CONSENSUS_BINS = [("1", 1, 1), ("2-4", 2, 4), ("5+", 5, None)]


def _returns(md: MarketData, recs: DataFrame, horizons=(1,)) -> DataFrame:
    """Distinct (ts_code, month) of ``recs`` with first close and k-month last closes."""
    return month_closes(md.bars(), recs.select("ts_code", "month"), horizons)


def pick_returns(md: MarketData, recs: DataFrame | None = None) -> DataFrame:
    """(ts_code, month, first_close, last_close, ret) for every recommended pair, INNER semantics:
    pairs without a first or last bar are dropped (as the source's inner joins do)."""
    recs = recs if recs is not None else md.broker_recommend()
    r = _returns(md, recs)
    return (r.where(F.col("first_close").isNotNull() & F.col("last_close_1").isNotNull())
            .select("ts_code", "month", "first_close", F.col("last_close_1").alias("last_close"),
                    pct_change("first_close", "last_close_1").alias("ret")))


def broker_rank(md: MarketData, limit: int = 20) -> DataFrame:
    """Per month: the ``limit`` brokers with most picks, their distinct stocks and the
    average month return over their distinct priced stocks."""
    recs = md.broker_recommend().select("month", "broker", "ts_code")
    counts = recs.groupBy("month", "broker").agg(F.count(F.lit(1)).alias("rec_cnt"),
                                                 F.count_distinct("ts_code").alias("stock_cnt"))
    rets = pick_returns(md, recs)
    perf = (recs.distinct().join(rets, ["ts_code", "month"])
            .groupBy("month", "broker").agg(F.round(F.avg("ret"), 2).alias("avg_return")))
    w = Window.partitionBy("month").orderBy(F.col("rec_cnt").desc(), F.col("broker").asc())
    ranked = counts.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= limit)
    return ranked.join(perf, ["month", "broker"], "left").select(
        "month", "rank", "broker", "rec_cnt", "stock_cnt", "avg_return")


def top_stocks(md: MarketData, limit: int = 15) -> DataFrame:
    """Per month: the ``limit`` most-recommended stocks (ties by code), their broker
    count, hot flag (>= 5 picks) and month return; LEFT semantics for prices."""
    recs = md.broker_recommend()
    counts = recs.groupBy("month", "ts_code", "name").agg(F.count(F.lit(1)).alias("rec_cnt"),
                                                          F.count_distinct("broker").alias("broker_cnt"))
    w = Window.partitionBy("month").orderBy(F.col("rec_cnt").desc(), F.col("ts_code").asc())
    top = counts.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= limit)
    r = _returns(md, top.select("ts_code", "month"))
    priced = F.col("first_close").isNotNull() & F.col("last_close_1").isNotNull()
    return top.join(r, ["ts_code", "month"], "left").select(
        "month", "rank", "ts_code", "name", "rec_cnt", "broker_cnt",
        (F.col("rec_cnt") >= 5).alias("is_hot"),
        F.when(priced, F.round(pct_change("first_close", "last_close_1"), 2)).alias("month_return"),
        F.when(priced, F.round("first_close", 2)).alias("first_close"),
        F.when(priced, F.round("last_close_1", 2)).alias("last_close"))


def pick_performance(md: MarketData) -> DataFrame:
    """Every (stock, month) pick: first bar, month and 3-month return, and its brokers."""
    recs = md.broker_recommend()
    r = _returns(md, recs, horizons=(1, 3))
    brokers = recs.groupBy("ts_code", "month").agg(
        F.array_join(F.sort_array(F.collect_set("broker")), ",").alias("brokers"))
    return (r.where(F.col("first_close").isNotNull()).join(brokers, ["ts_code", "month"])
            .select("ts_code", "month", "first_date", F.round("first_close", 2).alias("first_close"),
                    F.round(pct_change("first_close", "last_close_1"), 2).alias("month_return"),
                    F.round(pct_change("first_close", "last_close_3"), 2).alias("m3_return"),
                    "brokers"))


def broker_history(md: MarketData, months: int = 12) -> DataFrame:
    """Per broker, its ``months`` most recent months: priced picks, ups, hit rate, mean return.
    Months without any priced pick do not appear (inner semantics)."""
    recs = md.broker_recommend().select("month", "broker", "ts_code")
    w = Window.partitionBy("broker").orderBy(F.col("month").desc())
    recent = (recs.select("broker", "month").distinct()
              .withColumn("__r", F.dense_rank().over(w)).where(F.col("__r") <= months).drop("__r"))
    priced = recs.join(recent, ["broker", "month"], "left_semi").join(pick_returns(md, recs), ["ts_code", "month"])
    return priced.groupBy("broker", "month").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col("last_close") - F.col("first_close") > 0, 1).otherwise(0)).cast("bigint").alias("up_cnt"),
        F.round(F.avg("ret"), 2).alias("avg_return"),
    ).withColumn("hit_rate", safe_ratio_pct("up_cnt", "total", 1))


def broker_profile(md: MarketData) -> DataFrame:
    """Per (broker, month): picks, unique stocks, top-3 concentration and repeat rate
    (share of picks the broker already recommended in an earlier month).

    The top-3 is a ``row_number() <= 3`` filter, which Spark turns into a partial
    per-partition limit before the shuffle (``WindowGroupLimit``), so a broker-month
    with very many stocks is never sorted whole in one task."""
    recs = md.broker_recommend().select("month", "broker", "ts_code")
    per_stock = recs.groupBy("broker", "month", "ts_code").agg(F.count(F.lit(1)).alias("n"))
    ws = Window.partitionBy("broker", "month").orderBy(F.col("n").desc(), F.col("ts_code"))
    top3 = (per_stock.withColumn("__r", F.row_number().over(ws)).where(F.col("__r") <= 3)
            .groupBy("broker", "month").agg(F.sum("n").alias("__top")))
    first = per_stock.groupBy("broker", "ts_code").agg(F.min("month").alias("__first"))
    totals = (per_stock.join(first, ["broker", "ts_code"])
              .groupBy("broker", "month").agg(
                  F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique_stocks"),
                  F.sum(F.when(F.col("__first") < F.col("month"), F.col("n")).otherwise(0)).alias("__rep")))
    return totals.join(top3, ["broker", "month"]).select(
        "broker", "month", "total", "unique_stocks",
        safe_ratio_pct("__top", "total", 1).alias("top3_ratio"),
        safe_ratio_pct("__rep", "total", 1).alias("repeat_rate"))


def repeat_rate(md: MarketData) -> DataFrame:
    """Per (broker, month): picks that the same broker recommended in an earlier month."""
    recs = md.broker_recommend().select("month", "broker", "ts_code")
    first = recs.groupBy("broker", "ts_code").agg(F.min("month").alias("__first"))
    j = recs.join(first, ["broker", "ts_code"])
    return j.groupBy("broker", "month").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("__first") < F.col("month")).alias("repeated")
    ).withColumn("repeat_rate", safe_ratio_pct("repeated", "total", 1))


def broker_industries(md: MarketData, top: int = 5) -> DataFrame:
    """Per (broker, month): the ``top`` industries of the picks (NULL industry left out)."""
    recs = md.broker_recommend().select("month", "broker", "ts_code")
    sb = md.stock_basic().select("ts_code", "industry")
    c = (recs.join(sb, "ts_code", "left").where(F.col("industry").isNotNull())
         .groupBy("broker", "month", "industry").agg(F.count(F.lit(1)).alias("cnt")))
    w = Window.partitionBy("broker", "month").orderBy(F.col("cnt").desc(), F.col("industry"))
    return c.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top)


def benchmark_excess(md: MarketData, benchmark: str = BENCHMARK_CODE) -> DataFrame:
    """Per month and broker: average pick return, the benchmark's month return and the
    excess; rank puts missing excess last."""
    recs = md.broker_recommend().select("month", "broker", "ts_code")
    months = recs.select("month").distinct()
    # one as-of pass for the picks and the benchmark of every month; both consumers
    # read the same plan, so its shuffles are reused
    req = recs.select("ts_code", "month").unionByName(months.select(F.lit(benchmark).alias("ts_code"), "month"))
    r = _returns(md, req)
    priced = F.col("first_close").isNotNull() & F.col("last_close_1").isNotNull()
    bench = r.where(F.col("ts_code") == benchmark).select(
        "month", F.when(priced, F.round(pct_change("first_close", "last_close_1"), 2)).alias("benchmark_return"))
    rets = r.where(priced).select("ts_code", "month", pct_change("first_close", "last_close_1").alias("ret"))
    perf = (recs.join(rets, ["ts_code", "month"])
            .groupBy("month", "broker").agg(F.round(F.avg("ret"), 2).alias("avg_return")))
    # one benchmark row per month: bounded by the calendar, safe to broadcast
    j = (recs.select("month", "broker").distinct().join(perf, ["month", "broker"], "left")
         .join(F.broadcast(bench), "month", "left"))
    excess = F.round(F.col("avg_return") - F.col("benchmark_return"), 2)
    w = Window.partitionBy("month").orderBy(F.col("excess_return").desc_nulls_last(), F.col("broker"))
    return (j.select("month", "broker", "avg_return", "benchmark_return", excess.alias("excess_return"))
            .withColumn("rank", F.row_number().over(w).cast("bigint")))


def _consensus(md: MarketData) -> DataFrame:
    """Per month and priced stock: distinct brokers, mean return (unrounded), picks."""
    recs = md.broker_recommend()
    j = recs.join(pick_returns(md, recs.select("ts_code", "month")), ["ts_code", "month"])
    return j.groupBy("month", "ts_code", "name").agg(
        F.count_distinct("broker").alias("broker_cnt"),
        F.avg("ret").alias("avg_return"),
        F.count(F.lit(1)).alias("total_rec"))


def consensus_scatter(md: MarketData) -> DataFrame:
    """Per month and priced stock; the mean is shown to 4 digits."""
    return _consensus(md).withColumn("avg_return", F.round("avg_return", 4))


def consensus_groups(md: MarketData) -> DataFrame:
    """Per month: stocks in each consensus bin (1 / 2-4 / 5+ brokers) and the mean of
    their non-NULL returns. All three bins appear for every month that has a priced
    pick: one conditional aggregation per month, exploded into the three bins."""
    sc = _consensus(md)
    cnt = F.col("broker_cnt")
    aggs, bins = [], []
    for i, (label, lo, hi) in enumerate(CONSENSUS_BINS):
        inside = (cnt >= lo) if hi is None else cnt.between(lo, hi)
        aggs += [F.count_if(inside).alias(f"__c{i}"),
                 F.round(F.avg(F.when(inside, F.col("avg_return"))), 2).alias(f"__a{i}")]
        bins.append(F.struct(F.lit(label).alias("group"), F.col(f"__c{i}").alias("count"),
                             F.col(f"__a{i}").alias("avg_return")))
    per_month = sc.groupBy("month").agg(*aggs)
    return per_month.select("month", F.explode(F.array(*bins)).alias("__g")).select("month", "__g.*")


def lagged_returns(md: MarketData, horizons=(1, 3, 6)) -> DataFrame:
    """Every pick's return after 1, 3 and 6 months (one row per horizon)."""
    recs = md.broker_recommend()
    r = _returns(md, recs, horizons=horizons).where(F.col("first_close").isNotNull())
    per = F.explode(F.array(*[F.struct(F.lit(k).alias("months"),
                                       F.round(pct_change("first_close", f"last_close_{k}"), 2).alias("ret"))
                              for k in horizons])).alias("__h")
    return r.select("ts_code", "month", F.round("first_close", 2).alias("first_close"), per).select(
        "ts_code", "month", "first_close", F.col("__h.months").alias("months"), F.col("__h.ret").alias("ret"))


def broker_heatmap(md: MarketData, start_month: str | None = None, end_month: str | None = None) -> DataFrame:
    from tidemark.functions.predicates import where_all
    recs = where_all(md.broker_recommend(),
                     None if start_month is None else F.col("month") >= start_month,
                     None if end_month is None else F.col("month") <= end_month)
    return recs.groupBy("broker", "month").agg(F.count(F.lit(1)).alias("cnt"))


def rec_months(md: MarketData) -> DataFrame:
    return md.broker_recommend().select("month").distinct()


def rec_brokers(md: MarketData) -> DataFrame:
    return md.broker_recommend().groupBy("broker").agg(F.count(F.lit(1)).alias("cnt"))


def recs(md: MarketData, month=None, broker=None, ts_code=None, broker_like=None) -> DataFrame:
    """Recommendations with optional month / broker (exact, or a part of it) / symbol filters."""
    from tidemark.functions.predicates import contains_like, eq, where_all
    return where_all(md.broker_recommend(), eq("month", month), eq("broker", broker),
                     contains_like("broker", broker_like), eq("ts_code", ts_code))


def recs_sorted(md: MarketData, **filters) -> DataFrame:
    """Recommendations newest month first, then by broker and symbol."""
    return recs(md, **filters).orderBy(F.col("month").desc(), "broker", "ts_code")


def first_bar_semi(md: MarketData) -> DataFrame:
    """Row-value semi-join: the bar rows that are the first bar of their symbol on or
    after each recommendation month start (the reference's ``(code, date) IN (...)``)."""
    from tidemark.functions.dates import month_start
    r = _returns(md, md.broker_recommend())
    firsts = r.select("ts_code", F.col("first_date").alias("trade_date")).where("trade_date IS NOT NULL")
    return md.bars().join(firsts, ["ts_code", "trade_date"], "left_semi").select("ts_code", "trade_date", "close")


def _report_requests(md: MarketData) -> DataFrame:
    return md.report_rc().select("ts_code", "report_date").distinct()


def asof_forward(md: MarketData) -> DataFrame:
    """For every (symbol, report date): the first bar on or after the report date."""
    from tidemark.operators.asof import asof_join
    return asof_join(_report_requests(md), md.bars(), ["ts_code"], "report_date", "trade_date", ["close"],
                     direction="forward", inclusive=True)


def asof_backward(md: MarketData) -> DataFrame:
    """For every (symbol, report date): the last bar strictly before the report date."""
    from tidemark.operators.asof import asof_join
    return asof_join(_report_requests(md), md.bars(), ["ts_code"], "report_date", "trade_date", ["close"],
                     direction="backward", inclusive=False)


# ---------------------------------------------------------------------------
# registry: query name -> callable(md) and the equivalent DuckDB SQL
QUERIES = {
    "broker_rank": broker_rank,
    "top_stocks": top_stocks,
    "pick_performance": pick_performance,
    "broker_history": broker_history,
    "broker_profile": broker_profile,
    "repeat_rate": repeat_rate,
    "broker_industries": broker_industries,
    "benchmark_excess": benchmark_excess,
    "consensus_scatter": consensus_scatter,
    "consensus_groups": consensus_groups,
    "lagged_returns": lagged_returns,
    "broker_heatmap": broker_heatmap,
    "broker_heatmap_range": lambda md: broker_heatmap(md, "199501", "199612"),
    "rec_months": rec_months,
    "rec_brokers": rec_brokers,
    "recs": recs,
    "recs_broker": lambda md: recs_sorted(md, broker="NATION_1"),
    "first_bar_semi": first_bar_semi,
    "asof_forward": asof_forward,
    "asof_backward": asof_backward,
}

ORACLE = {
    "asof_forward": """
SELECT r.ts_code, r.report_date, b.trade_date, b.close
FROM (SELECT DISTINCT ts_code, report_date FROM v_report_rc) r
ASOF LEFT JOIN v_bars b ON r.ts_code = b.ts_code AND r.report_date <= b.trade_date""",
    "asof_backward": """
SELECT r.ts_code, r.report_date, b.trade_date, b.close
FROM (SELECT DISTINCT ts_code, report_date FROM v_report_rc) r
ASOF LEFT JOIN v_bars b ON r.ts_code = b.ts_code AND r.report_date > b.trade_date""",
    "broker_rank": """
WITH counts AS (SELECT month, broker, count(*) AS rec_cnt, count(DISTINCT ts_code) AS stock_cnt
                FROM v_recs GROUP BY month, broker),
ranked AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY rec_cnt DESC, broker ASC) AS rank FROM counts),
perf AS (SELECT r.month, r.broker, round(avg(t.ret), 2) AS avg_return
         FROM (SELECT DISTINCT month, broker, ts_code FROM v_recs) r JOIN v_pick_ret t USING (ts_code, month)
         GROUP BY r.month, r.broker)
SELECT k.month, k.rank, k.broker, k.rec_cnt, k.stock_cnt, p.avg_return
FROM ranked k LEFT JOIN perf p USING (month, broker) WHERE k.rank <= 20""",
    "top_stocks": """
WITH c AS (SELECT month, ts_code, name, count(*) AS rec_cnt, count(DISTINCT broker) AS broker_cnt
           FROM v_recs GROUP BY month, ts_code, name),
t AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY rec_cnt DESC, ts_code ASC) AS rank FROM c)
SELECT t.month, t.rank, t.ts_code, t.name, t.rec_cnt, t.broker_cnt, t.rec_cnt >= 5 AS is_hot,
       CASE WHEN r.fc IS NOT NULL AND r.lc1 IS NOT NULL THEN round((r.lc1 - r.fc) / nullif(r.fc, 0) * 100, 2) END
           AS month_return,
       CASE WHEN r.fc IS NOT NULL AND r.lc1 IS NOT NULL THEN round(r.fc, 2) END AS first_close,
       CASE WHEN r.fc IS NOT NULL AND r.lc1 IS NOT NULL THEN round(r.lc1, 2) END AS last_close
FROM t LEFT JOIN v_ret r USING (ts_code, month) WHERE t.rank <= 15""",
    "pick_performance": """
SELECT r.ts_code, r.month, r.first_date, round(r.fc, 2) AS first_close,
       round((r.lc1 - r.fc) / nullif(r.fc, 0) * 100, 2) AS month_return,
       round((r.lc3 - r.fc) / nullif(r.fc, 0) * 100, 2) AS m3_return, b.brokers
FROM v_ret136 r JOIN (SELECT ts_code, month, string_agg(DISTINCT broker, ',' ORDER BY broker) AS brokers
                      FROM v_recs GROUP BY ts_code, month) b USING (ts_code, month)
WHERE r.fc IS NOT NULL""",
    "broker_history": """
WITH bm AS (SELECT broker, month, dense_rank() OVER (PARTITION BY broker ORDER BY month DESC) AS rk
            FROM (SELECT DISTINCT broker, month FROM v_recs))
SELECT br.broker, br.month, count(*) AS total,
       CAST(sum(CASE WHEN (p.last_close - p.first_close) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS up_cnt,
       round(avg(p.ret), 2) AS avg_return,
       round(CAST(sum(CASE WHEN (p.last_close - p.first_close) > 0 THEN 1 ELSE 0 END) AS DOUBLE)
             / nullif(CAST(count(*) AS DOUBLE), 0) * 100, 1) AS hit_rate
FROM v_recs br JOIN bm ON br.broker = bm.broker AND br.month = bm.month AND bm.rk <= 12
JOIN v_pick_ret p ON br.ts_code = p.ts_code AND br.month = p.month
GROUP BY br.broker, br.month""",
    "broker_profile": """
WITH ps AS (SELECT broker, month, ts_code, count(*) AS n FROM v_recs GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY broker, month ORDER BY n DESC, ts_code) AS rn,
             min(month) OVER (PARTITION BY broker, ts_code) AS first_m FROM ps)
SELECT broker, month, CAST(sum(n) AS BIGINT) AS total, count(*) AS unique_stocks,
       round(CAST(sum(CASE WHEN rn <= 3 THEN n ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(n) AS DOUBLE), 0) * 100, 1)
           AS top3_ratio,
       round(CAST(sum(CASE WHEN first_m < month THEN n ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(n) AS DOUBLE), 0)
             * 100, 1) AS repeat_rate
FROM r GROUP BY broker, month""",
    "repeat_rate": """
SELECT cur.broker, cur.month, count(*) AS total,
       count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v_recs prev WHERE prev.broker = cur.broker
                                      AND prev.ts_code = cur.ts_code AND prev.month < cur.month)) AS repeated,
       round(CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v_recs prev WHERE prev.broker = cur.broker
                                      AND prev.ts_code = cur.ts_code AND prev.month < cur.month)) AS DOUBLE)
             / nullif(CAST(count(*) AS DOUBLE), 0) * 100, 1) AS repeat_rate
FROM v_recs cur GROUP BY cur.broker, cur.month""",
    "broker_industries": """
WITH c AS (SELECT r.broker, r.month, s.industry, count(*) AS cnt
           FROM v_recs r LEFT JOIN v_stock_basic s ON r.ts_code = s.ts_code
           WHERE s.industry IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY broker, month ORDER BY cnt DESC, industry) AS rank FROM c)
WHERE rank <= 5""",
    "benchmark_excess": """
WITH bench AS (
  SELECT m.month, CASE WHEN f.close IS NOT NULL AND l.close IS NOT NULL
                  THEN round((l.close - f.close) / nullif(f.close, 0) * 100, 2) END AS benchmark_return
  FROM (SELECT DISTINCT month, CAST(strptime(month || '01', '%Y%m%d') AS DATE) AS ms FROM v_recs) m
  LEFT JOIN LATERAL (SELECT close FROM v_bars b WHERE b.ts_code = 'S0' AND b.trade_date >= m.ms
                     ORDER BY trade_date ASC LIMIT 1) f ON TRUE
  LEFT JOIN LATERAL (SELECT close FROM v_bars b WHERE b.ts_code = 'S0'
                     AND b.trade_date < CAST(m.ms + INTERVAL 1 MONTH AS DATE)
                     ORDER BY trade_date DESC LIMIT 1) l ON TRUE),
perf AS (SELECT br.month, br.broker, round(avg(p.ret), 2) AS avg_return
         FROM v_recs br JOIN v_pick_ret p USING (ts_code, month) GROUP BY ALL),
j AS (SELECT b.month, b.broker, p.avg_return, bench.benchmark_return,
             round(p.avg_return - bench.benchmark_return, 2) AS excess_return
      FROM (SELECT DISTINCT month, broker FROM v_recs) b LEFT JOIN perf p USING (month, broker)
      LEFT JOIN bench USING (month))
SELECT *, row_number() OVER (PARTITION BY month ORDER BY excess_return DESC NULLS LAST, broker) AS rank FROM j""",
    "consensus_scatter": """
SELECT br.month, br.ts_code, br.name, count(DISTINCT br.broker) AS broker_cnt, round(avg(p.ret), 4) AS avg_return,
       count(*) AS total_rec
FROM v_recs br JOIN v_pick_ret p USING (ts_code, month) GROUP BY br.month, br.ts_code, br.name""",
    "consensus_groups": """
WITH sc AS (SELECT br.month, br.ts_code, br.name, count(DISTINCT br.broker) AS broker_cnt,
                   avg(p.ret) AS avg_return
            FROM v_recs br JOIN v_pick_ret p USING (ts_code, month) GROUP BY br.month, br.ts_code, br.name),
g AS (SELECT month, CASE WHEN broker_cnt = 1 THEN '1' WHEN broker_cnt <= 4 THEN '2-4' ELSE '5+' END AS "group",
             count(*) AS count, round(avg(avg_return), 2) AS avg_return FROM sc GROUP BY ALL),
spine AS (SELECT m.month, b.g AS "group" FROM (SELECT DISTINCT month FROM sc) m,
          (VALUES ('1'), ('2-4'), ('5+')) b(g))
SELECT s.month, s."group", coalesce(g.count, 0) AS count, g.avg_return
FROM spine s LEFT JOIN g USING (month, "group")""",
    "lagged_returns": """
SELECT r.ts_code, r.month, round(r.fc, 2) AS first_close, h.months,
       round((CASE h.months WHEN 1 THEN r.lc1 WHEN 3 THEN r.lc3 ELSE r.lc6 END - r.fc) / nullif(r.fc, 0) * 100, 2)
           AS ret
FROM v_ret136 r, (VALUES (1), (3), (6)) h(months) WHERE r.fc IS NOT NULL""",
    "broker_heatmap": "SELECT broker, month, count(*) AS cnt FROM v_recs GROUP BY broker, month",
    "broker_heatmap_range": """
SELECT broker, month, count(*) AS cnt FROM v_recs WHERE month BETWEEN '199501' AND '199612' GROUP BY broker, month""",
    "recs_broker": "SELECT * FROM v_recs WHERE broker = 'NATION_1' ORDER BY month DESC, broker, ts_code",
    "rec_months": "SELECT DISTINCT month FROM v_recs",
    "rec_brokers": "SELECT broker, count(*) AS cnt FROM v_recs GROUP BY broker",
    "recs": "SELECT * FROM v_recs",
    "first_bar_semi": """
SELECT ts_code, trade_date, close FROM v_bars
WHERE (ts_code, trade_date) IN (SELECT ts_code, first_date FROM v_ret WHERE first_date IS NOT NULL)""",
}
