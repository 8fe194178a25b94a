"""As-of month closes and the general bucketed as-of join."""

import datetime as dt
import random

import pytest

from conftest import rows
from tidemark.operators.asof import asof_join, month_closes

BARS = "ts_code string, trade_date date, close double"
REQ = "ts_code string, month string"


def d(s):
    return dt.date.fromisoformat(s)


def test_same_date_boundary(spark):
    bars = spark.createDataFrame([("A", d("2024-01-31"), 5.0), ("A", d("2024-02-01"), 10.0),
                                  ("A", d("2024-02-29"), 12.0), ("A", d("2024-03-01"), 13.0)], BARS)
    r = month_closes(bars, spark.createDataFrame([("A", "202402")], REQ)).collect()[0]
    assert r["first_date"] == d("2024-02-01") and r["first_close"] == 10.0  # >= month start
    assert r["last_close_1"] == 12.0  # strictly before next month start


def test_suspended_stock_borrows_other_months(spark):
    bars = spark.createDataFrame([("A", d("2024-01-15"), 5.0), ("A", d("2024-04-10"), 8.0)], BARS)
    r = month_closes(bars, spark.createDataFrame([("A", "202402")], REQ), horizons=(1, 3)).collect()[0]
    assert r["first_close"] == 8.0  # first bar on/after Feb 1 is in April
    assert r["last_close_1"] == 5.0  # last bar before Mar 1 is in January
    assert r["last_close_3"] == 8.0  # last bar before May 1 is the April one


def test_no_bar_at_all(spark):
    bars = spark.createDataFrame([("B", d("2024-01-15"), 5.0)], BARS)
    r = month_closes(bars, spark.createDataFrame([("A", "202401")], REQ)).collect()[0]
    assert r["first_close"] is None and r["last_close_1"] is None


def test_zero_first_close_gives_null_return(spark):
    from pyspark.sql import functions as F

    from tidemark.functions.numeric import pct_change
    df = spark.createDataFrame([(0.0, 5.0), (2.0, 3.0)], "f double, l double")
    assert [r[0] for r in df.select(pct_change("f", "l")).collect()] == [None, 50.0]


def _brute(left, right, fwd, inclusive):
    out = []
    for k, t in left:
        cands = [(rt, v) for rk, rt, v in right if rk == k and
                 ((rt >= t if inclusive else rt > t) if fwd else (rt <= t if inclusive else rt < t))]
        if not cands:
            out.append((k, t, None, None))
        else:
            rt, v = (min if fwd else max)(cands)
            out.append((k, t, rt, v))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fwd,inclusive", [(True, True), (True, False), (False, True), (False, False)])
def test_asof_join_matches_brute_force(spark, fwd, inclusive):
    rnd = random.Random(7)
    base = d("2023-10-01")
    right = [(k, base + dt.timedelta(days=rnd.randrange(0, 200)), float(i))
             for i, k in enumerate(rnd.choice("ABC") for _ in range(120))]
    right = list({(k, t): (k, t, v) for k, t, v in right}.values())  # one row per (key, time)
    left = sorted({(rnd.choice("ABCD"), base + dt.timedelta(days=rnd.randrange(-20, 230))) for _ in range(150)})
    L = spark.createDataFrame(left, "k string, t date")
    R = spark.createDataFrame(right, "k string, rt date, v double")
    got = asof_join(L, R, ["k"], "t", "rt", ["v"], direction="forward" if fwd else "backward",
                    inclusive=inclusive)
    assert rows(got, "k", "t", "rt", "v") == _brute(left, right, fwd, inclusive)


def test_asof_nulls_match_nothing_and_duplicates_have_a_winner(spark):
    import pytest
    from pyspark.sql import functions as F
    left = spark.createDataFrame([(1, "a", "2024-01-10"), (2, None, "2024-01-10"), (3, "a", None), (4, "a", "2024-03-01")],
                                 "id int, k string, t string").withColumn("t", F.to_date("t"))
    right = spark.createDataFrame([("a", "2024-01-12", 5.0), ("a", "2024-01-12", 4.0), (None, "2024-01-12", 9.0), ("a", None, 8.0),
                                   ("a", "2024-02-02", 1.0), ("a", "2024-02-02", 2.0)],
                                  "k string, rt string, v double").withColumn("rt", F.to_date("rt"))
    fwd = {r.id: r.v for r in asof_join(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert fwd == {1: 4.0, 2: None, 3: None, 4: None}
    back = {r.id: r.v for r in asof_join(left, right, ["k"], "t", "rt", ["v"], direction="backward").collect()}
    assert back == {1: None, 2: None, 3: None, 4: 2.0}
    with pytest.raises(ValueError):
        asof_join(left.withColumnRenamed("id", "rt"), right, ["k"], "t", "rt", ["v"])


def test_month_closes_take_a_null_close_alike_on_both_sides(spark):
    from pyspark.sql import functions as F
    bars = spark.createDataFrame([("A", "2024-01-05", 1.0), ("A", "2024-02-05", None)],
                                 "ts_code string, trade_date string, close double").withColumn("trade_date", F.to_date("trade_date"))
    r = month_closes(bars, spark.createDataFrame([("A", "202402")], "ts_code string, month string")).first()
    assert r.first_close is None and r.last_close_1 is None and str(r.first_date) == "2024-02-05"


@pytest.mark.parametrize("fwd", [True, False])
def test_asof_hot_key_spreads_over_tasks(spark, fwd):
    """A million requests of one key and month: no task gets them all, the answers are those of a bisection."""
    import bisect

    from pyspark.sql import functions as F

    n = 1_000_000
    left = spark.range(n).select(F.lit("HOT").alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.lit(2_000_000))).alias("t"), "id")
    left = left.unionByName(spark.range(200_000).select(F.lit("HOT").alias("k"), F.timestamp_seconds(F.lit(1_700_500_000)).alias("t"), (F.col("id") + n).alias("id")))
    series = spark.range(400).select(F.lit("HOT").alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 4999).alias("rt"), F.col("id").cast("double").alias("v"))
    got = asof_join(left, series, ["k"], "t", "rt", ["v"], direction="forward" if fwd else "backward")
    times = [1_700_000_000 + i * 4999 for i in range(400)]
    want = {}
    asked = left.select(F.unix_timestamp("t").alias("s")).distinct().toPandas()["s"]
    for s in asked:
        at = bisect.bisect_left(times, s) if fwd else bisect.bisect_right(times, s) - 1
        want[int(s)] = float(at) if 0 <= at < 400 else None
    pdf = got.select(F.unix_timestamp("t").alias("s"), "v").toPandas()
    assert len(pdf) == n + 200_000
    assert all((None if v != v else v) == want[int(s)] for s, v in zip(pdf["s"], pdf["v"], strict=True))
    parts = got.select("t").inputFiles()  # the staged merge: one file per range partition
    sizes = [r["count"] for r in spark.read.parquet(*parts).groupBy("__part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * (n + 200_000)
