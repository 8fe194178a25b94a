"""Coverage, gaps, backfill chunks, period and month plans."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import calendar as C

S = "ts_code string, trade_date date"
CAL = "exchange string, cal_date date, is_open boolean"


def d(s):
    return dt.date.fromisoformat(s)


def _cal(spark):
    days = [d("2024-01-01") + dt.timedelta(days=i) for i in range(14)]
    return spark.createDataFrame([("X", x, x.weekday() < 5) for x in days], CAL)


def test_coverage_counts_and_unknown_symbol(spark):
    series = spark.createDataFrame([("A", d("2024-01-01")), ("A", d("2024-01-03")), ("A", d("2024-01-05")),
                                    ("B", d("2024-01-08"))], S)
    codes = spark.createDataFrame([("A",), ("B",), ("Z",)], "ts_code string")
    rep = {r["ts_code"]: r for r in C.coverage_report(series, "ts_code", "trade_date", _cal(spark), codes).collect()}
    assert (rep["A"]["actual"], rep["A"]["expected"], rep["A"]["missing"]) == (3, 5, 2)
    assert rep["A"]["coverage_pct"] == 60.0
    assert (rep["B"]["actual"], rep["B"]["expected"], rep["B"]["missing"]) == (1, 1, 0)
    z = rep["Z"]
    assert (z["actual"], z["expected"], z["missing"], z["coverage_pct"], z["min_date"]) == (0, 0, 0, 0.0, None)


def test_coverage_without_calendar_expected_equals_actual(spark):
    series = spark.createDataFrame([("A", d("2024-01-01")), ("A", d("2024-01-09"))], S)
    r = C.coverage_report(series, "ts_code", "trade_date").collect()[0]
    assert r["expected"] == r["actual"] == 2 and r["missing"] == 0


def test_missing_plus_actual_is_expected_and_chunks_cover(spark):
    cal = _cal(spark)
    series = spark.createDataFrame([("A", x) for x in [d("2024-01-01"), d("2024-01-04"), d("2024-01-12")]], S)
    miss = C.missing_dates(series, "ts_code", "trade_date", cal)
    rep = C.coverage_report(series, "ts_code", "trade_date", cal).collect()[0]
    assert miss.count() + rep["actual"] == rep["expected"]
    plan = C.backfill_plan(miss, "ts_code", "missing_date", chunk=3).collect()
    assert sum(p["n_dates"] for p in plan) == miss.count()
    # each chunk's range contains exactly its dates
    m = [r["missing_date"] for r in miss.collect()]
    assert sorted(m) == sorted(x for p in plan for x in m if p["start_date"] <= x <= p["end_date"])


def test_no_gaps_no_plan(spark):
    cal = _cal(spark)
    series = spark.createDataFrame([("A", d("2024-01-01")), ("A", d("2024-01-02"))], S)
    assert C.missing_dates(series, "ts_code", "trade_date", cal).count() == 0


def _ranges(spark, pairs):
    return spark.createDataFrame([(str(i), d(a), d(b)) for i, (a, b) in enumerate(pairs)],
                                 "range_id string, start_date date, end_date date")


def test_period_plan_day_quarter_boundary(spark):
    p60 = C.period_plan(_ranges(spark, [("2024-01-01", "2024-03-01")]), 60).collect()  # 60 days
    assert len(p60) == 61 and {r["mode"] for r in p60} == {"day"}
    p61 = C.period_plan(_ranges(spark, [("2024-01-01", "2024-03-02")]), 60).collect()  # 61 days
    assert [(r["period_start"], r["period_end"]) for r in sorted(p61, key=lambda r: r["period_start"])] == [
        (d("2024-01-01"), d("2024-03-02"))]


def test_period_plan_leap_year_and_empty(spark):
    p = C.period_plan(_ranges(spark, [("2024-01-01", "2024-12-31")]), 60).collect()
    assert len(p) == 4 and min(r["period_start"] for r in p) == d("2024-01-01")
    assert max(r["period_end"] for r in p) == d("2024-12-31")
    clipped = C.period_plan(_ranges(spark, [("2024-02-15", "2024-08-10")]), 60).collect()
    assert sorted((r["period_start"], r["period_end"]) for r in clipped) == [
        (d("2024-02-15"), d("2024-03-31")), (d("2024-04-01"), d("2024-06-30")), (d("2024-07-01"), d("2024-08-10"))]
    assert C.period_plan(_ranges(spark, [("2024-05-01", "2024-01-01")]), 60).count() == 0


def test_month_plan(spark):
    m = C.month_plan(_ranges(spark, [("2023-11-20", "2024-02-03")])).collect()
    assert [r["month"] for r in sorted(m, key=lambda r: r["month"])] == ["202311", "202312", "202401", "202402"]
    assert {r["month"]: r["month_end"] for r in m}["202402"] == d("2024-02-29")
    assert C.month_plan(_ranges(spark, [("2024-05-01", "2024-01-01")])).count() == 0


def test_trading_days_per_exchange_and_flag(spark):
    cal = _cal(spark).unionByName(spark.createDataFrame([("Y", d("2024-01-01"), True)], CAL))
    assert C.trading_days(cal, "X", is_open=True).count() == 10
    assert C.trading_days(cal, "X", is_open=False).count() == 4
    assert C.trading_days(cal, "X", is_open=None, start="20240102", end="2024-01-03").count() == 2
    assert C.trading_days(cal, "NOPE").count() == 0


def test_empty_exchange_has_null_range(md):
    from tidemark.plans.coverage import calendar_range
    r = {x["exchange"]: x for x in calendar_range(md).collect()}
    assert r["NOWHERE"]["min_date"] is None and r["NOWHERE"]["max_date"] is None
    assert r["ASIA"]["min_date"] is not None


def test_pretrade_date_is_previous_open_day(md):
    cal = md.trade_cal().where("exchange = 'ASIA'").orderBy("cal_date").collect()
    last_open = None
    for r in cal:
        assert r["pretrade_date"] == last_open
        if r["is_open"]:
            last_open = r["cal_date"]


def test_masks_match_brute_force_over_years_and_outside_the_calendar(spark):
    import random

    rng = random.Random(4)
    days = [d("2019-11-20") + dt.timedelta(days=i) for i in range(900)]
    cal = [(x, rng.random() < 0.7) for x in days if rng.random() < 0.9]  # closed days and days without a row
    cal += [(x, True) for x, _ in cal[:5]]  # a second exchange
    open_days = {x for x, is_open in cal if is_open}
    series = [(k, x) for k in ("A", "B") for x in rng.sample(days, 120)]
    series += [("A", series[0][1])] * 3 + [("before", d("2019-01-01")), ("before", d("2019-12-31")), ("after", d("2022-03-01")), ("after", d("2023-01-01")),
               ("out", d("2001-01-01")), ("out", d("2001-02-01")), ("one", days[7]), ("null", None)]
    s = spark.createDataFrame(series, S)
    c = spark.createDataFrame([("X", x, o) for x, o in cal], CAL)
    have = {}
    for k, x in series:
        have.setdefault(k, set()).update({x} - {None})
    want = sorted([(k, x) for k, v in have.items() for x in open_days if v and min(v) <= x <= max(v) and x not in v], key=repr)
    assert rows(C.missing_dates(s, "ts_code", "trade_date", c)) == want
    rep = {r.ts_code: r for r in C.coverage_report(s, "ts_code", "trade_date", c).collect()}
    for k, v in have.items():
        expected = sum(min(v) <= x <= max(v) for x in open_days) if v else 0
        assert (rep[k].actual, rep[k].expected or 0) == (len(v), expected), k
    # a calendar without open days expects nothing
    none = C.coverage_report(s, "ts_code", "trade_date", c.where("false")).where("ts_code = 'A'").first()
    assert none.expected == 0 and none.coverage_pct == 0.0 and C.missing_dates(s, "ts_code", "trade_date", c.where("false")).count() == 0


def test_coverage_needs_no_join_and_no_single_task_window(md):
    from tidemark.plans.coverage import coverage_report, missing_bars

    for q in (coverage_report, missing_bars):
        df = q(md)
        plan = df._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
        assert "Join" not in plan and "Expand" not in plan and "SinglePartition" not in plan.split("scalar-subquery")[0]
        assert "bit" in df._jdf.queryExecution().optimizedPlan().toString()
