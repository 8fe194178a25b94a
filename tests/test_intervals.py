"""Interval joins by bins against brute force; the plan joins on the bin."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators.intervals import interval_join

D0 = dt.date(2023, 1, 1)


def data(spark):
    rng = random.Random(2)
    day = lambda a, b: None if rng.random() < 0.05 else D0 + dt.timedelta(days=rng.randrange(a, b))
    points = [(rng.choice(["a", "b", "hot", None]), day(-60, 700), i) for i in range(400)]
    ranges = [(rng.choice(["a", "hot", None]), day(0, 500), day(0, 640), i) for i in range(60)]
    return points, ranges, spark.createDataFrame(points, "k string, day date, end_date int"), \
        spark.createDataFrame(ranges, "k string, start_date date, stop date, day int")


@pytest.mark.parametrize("width", [1, 32, 365])
def test_matches_brute_force(spark, width):
    points, ranges, p, r = data(spark)
    hit = [(x, y) for x in points for y in ranges if None not in (x[0], x[1], y[0], y[1], y[2]) and x[0] == y[0] and y[1] <= x[1] <= y[2]]
    r = r.withColumnRenamed("day", "n")
    got = interval_join(p, r, ["k"], "day", "start_date", "stop", width=width)
    assert got.columns == ["k", "day", "end_date", "start_date", "stop", "n"]
    assert rows(got) == sorted(((*x, *y[1:]) for x, y in hit), key=repr)
    semi = interval_join(p, r, ["k"], "day", "start_date", "stop", "left_semi", width)
    assert rows(semi, "end_date") == sorted({(x[2],) for x, _ in hit}, key=repr)
    anti = interval_join(p, r, ["k"], "day", "start_date", "stop", "left_anti", width)
    assert semi.count() + anti.count() == p.count() and anti.columns == p.columns


def test_plan_joins_on_the_bin(spark, md):
    from tidemark.plans.coverage import backfill_apply

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = backfill_apply(md)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "__bin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        interval_join(spark.range(1), spark.range(1), ["id"], "id", "id", "id", "full")


def test_empty_sides(spark):
    _, _, p, r = data(spark)
    r = r.drop("day")
    assert interval_join(p.where(F.lit(False)), r, ["k"], "day", "start_date", "stop").count() == 0
    assert interval_join(p, r.where(F.lit(False)), ["k"], "day", "start_date", "stop", "left_anti").count() == p.count()
