"""Per-row loops (the source application's N+1 shape) vs the one-pass plans.

usage: python tools/loop_vs_plan.py [--sf-dir DIR]
Runs, on the same session and stored tables:
  * broker ranking for one month: one as-of query per broker vs the one-pass plan
    (for that month, and for every month at once);
  * coverage report: three queries per symbol vs the one-pass plan;
  * forward as-of for the report dates: range-join (cross-join-like) form vs the
    bucketed running-window form.
Checks that both shapes give the same numbers and prints one JSON line of timings.
The loops are measurement baselines only; they are not part of the library.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tidemark.plans import coverage as COV  # noqa: E402
from tidemark.plans import picks as P  # noqa: E402
from tidemark.session import build_session  # noqa: E402
from tidemark.sources.store import StoredMarketData, build_all  # noqa: E402


def timed(fn):
    t0 = time.perf_counter()
    out = fn()
    return out, round(time.perf_counter() - t0, 3)


def naive_broker_rank(md, month: str, limit: int = 20):
    bars = md.bars()
    recs = md.broker_recommend()
    top = (recs.where(F.col("month") == month).groupBy("broker")
           .agg(F.count(F.lit(1)).alias("rec_cnt")).orderBy(F.col("rec_cnt").desc(), "broker").limit(limit)
           .collect())
    ms = F.to_date(F.lit(month + "01"), "yyyyMMdd")
    ns = F.add_months(ms, 1)
    out = {}
    for r in top:  # one query per broker, as the source does
        picks = recs.where((F.col("broker") == r["broker"]) & (F.col("month") == month)).select("ts_code").distinct()
        first_d = bars.where(F.col("trade_date") >= ms).groupBy("ts_code").agg(F.min("trade_date").alias("d"))
        last_d = bars.where(F.col("trade_date") < ns).groupBy("ts_code").agg(F.max("trade_date").alias("d"))
        f = bars.join(first_d.withColumnRenamed("d", "trade_date"), ["ts_code", "trade_date"]) \
            .select("ts_code", F.col("close").alias("fc"))
        lc = bars.join(last_d.withColumnRenamed("d", "trade_date"), ["ts_code", "trade_date"]) \
            .select("ts_code", F.col("close").alias("lc"))
        v = (picks.join(f, "ts_code").join(lc, "ts_code")
             .agg(F.round(F.avg((F.col("lc") - F.col("fc")) / F.nullif(F.col("fc"), F.lit(0.0)) * 100), 2))
             .collect()[0][0])
        out[r["broker"]] = v
    return out


def naive_coverage(md):
    days = md.event_days()
    cal = COV.event_calendar(md).select("cal_date").collect()
    cal_days = sorted(r[0] for r in cal)
    users = [r[0] for r in days.select("user_id").distinct().orderBy("user_id").collect()]
    out = {}
    for u in users:  # three queries per symbol, as the source does
        mine = days.where(F.col("user_id") == u)
        lo = mine.agg(F.min("day")).collect()[0][0]
        hi = mine.agg(F.max("day")).collect()[0][0]
        have = {r[0] for r in mine.select("day").collect()}
        expected = len([d for d in cal_days if lo <= d <= hi])
        out[u] = (len(have), expected)
    return out


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    a = ap.parse_args()
    spark = build_session()
    md = StoredMarketData(spark, a.sf_dir)
    build_all(md)
    month = (md.broker_recommend().groupBy("month").count().orderBy(F.col("count").desc(), "month").first()["month"])
    res = {"sf_dir": a.sf_dir, "month": month}

    naive, res["broker_rank_loop_one_month_sec"] = timed(lambda: naive_broker_rank(md, month))
    one, res["broker_rank_plan_one_month_sec"] = timed(
        lambda: {r["broker"]: r["avg_return"] for r in P.broker_rank(md).where(F.col("month") == month).collect()})
    _, res["broker_rank_plan_all_months_sec"] = timed(
        lambda: P.broker_rank(md).write.format("noop").mode("overwrite").save())
    res["broker_rank_same_result"] = naive == one

    naive_c, res["coverage_loop_sec"] = timed(lambda: naive_coverage(md))
    plan_c, res["coverage_plan_sec"] = timed(
        lambda: {r["user_id"]: (r["actual"], r["expected"]) for r in COV.coverage_report(md).collect()})
    res["coverage_same_result"] = naive_c == plan_c

    req = md.report_rc().select("ts_code", "report_date").distinct()
    bars = md.bars()

    def range_join_form():
        j = req.join(bars, (req.ts_code == bars.ts_code) & (bars.trade_date >= req.report_date), "left")
        return (j.groupBy(req.ts_code, req.report_date)
                .agg(F.min_by(bars.close, bars.trade_date).alias("close"), F.min(bars.trade_date).alias("trade_date")))

    rj, res["asof_range_join_sec"] = timed(lambda: sorted(tuple(r) for r in range_join_form()
                                                            .select("ts_code", "report_date", "trade_date", "close")
                                                            .collect()))
    wf, res["asof_window_sec"] = timed(lambda: sorted(tuple(r) for r in P.asof_forward(md)
                                                       .select("ts_code", "report_date", "trade_date", "close")
                                                       .collect()))
    res["asof_same_result"] = rj == wf
    print(json.dumps(res))
    spark.stop()


if __name__ == "__main__":
    main()
