"""Snapshot tables: failed writes keep the old version, batches apply once, only touched files are opened."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import merge
from tidemark.operators.merge import upsert_to_path
from tidemark.plans.loading import event_table
from tidemark.session import staging_path
from tidemark.sources import snapshots
from tidemark.sources.schemas import SPECS
from tidemark.sources.snapshots import SnapshotTable, load_market

BAR = "ts_code string, trade_date date, close double, vol double"


def bars(spark, data):
    return spark.createDataFrame([(c, dt.date.fromisoformat(d), p, v) for c, d, p, v in data], BAR)


def table(spark, name="adj_factor"):
    return SnapshotTable(spark, staging_path(spark, "t-snap"), SPECS[name])


def factors(spark, data):
    return spark.createDataFrame([(c, dt.date.fromisoformat(d), p) for c, d, p in data], "ts_code string, trade_date date, adj_factor double")


def content(t):
    return rows(t.read(), "ts_code", "trade_date", "adj_factor")


FIRST = [("A", "2023-05-01", 1.0), ("B", "2023-05-01", 1.0), ("A", "2024-05-01", 2.0)]


@pytest.mark.parametrize("broken", ["_write", "_publish", "swap"])
def test_failed_load_leaves_the_old_version(spark, monkeypatch, broken):
    t = table(spark)
    t.upsert(factors(spark, FIRST), batch_id="a")
    before, marks = content(t), rows(t.marks())

    def fail(*a, **k):
        raise OSError("disk gone")

    with monkeypatch.context() as m:
        m.setattr(*((snapshots, "swap_pointer") if broken == "swap" else (SnapshotTable, broken)), fail)
        with pytest.raises(OSError):
            t.upsert(factors(spark, [("A", "2023-05-01", 9.0)]), batch_id="b")
    assert content(t) == before and rows(t.marks()) == marks and not t.applied("b")
    t.upsert(factors(spark, [("A", "2023-05-01", 9.0)]), batch_id="b")
    assert ("A", dt.date(2023, 5, 1), 9.0) in content(t) and len(content(t)) == 3


def test_batch_applies_once_and_versions_stay_readable(spark):
    t = table(spark)
    assert t.version() is None and t.read().count() == 0
    assert t.upsert(factors(spark, FIRST), batch_id="a") == 1
    assert t.upsert(factors(spark, [("C", "2024-01-01", 1.0), ("A", "2024-05-01", 7.0)]), batch_id="b") == 2
    assert t.upsert(factors(spark, FIRST), batch_id="a") == 2  # replayed: nothing changes
    assert rows(t.read().where("ts_code = 'A'"), "adj_factor") == [(1.0,), (7.0,)]
    assert t.read(version=1).count() == 3 and t.read().count() == 4
    assert t.upsert(factors(spark, []), batch_id="none") == 3 and t.read().count() == 4


def test_append_adds_a_batch_once(spark):
    t = event_table(spark, staging_path(spark, "t-append"))
    e = spark.createDataFrame([(1, "x", dt.date(2024, 1, 1), 1.0, 5)], "user_id long, event_type string, day date, value double, event_id long")
    for batch in ("one", "one", "two", ("stream", 3), ("stream", 2), ("stream", 3), ("stream", 4)):
        t.append(e, batch)
    assert t.read().count() == 4  # one, two, epochs 3 and 4


def test_null_key_parts_are_keys_and_unknown_columns_go(spark):
    t = SnapshotTable(spark, staging_path(spark, "t-null"), SPECS["report_rc"])
    r = spark.createDataFrame([("A", dt.date(2024, 1, 1), "t", "o", None, "2024Q1", 1.0, "vendor"), ("A", None, "t", "o", None, "2024Q1", 2.0, "vendor")],
                              "ts_code string, report_date date, report_title string, org_name string, author_name string, quarter string, eps double, extra string")
    for _ in range(2):
        t.upsert(r)
    assert t.read().columns == SPECS["report_rc"].columns and t.read().count() == 2
    t.upsert(r.withColumn("eps", F.lit(5.0)))
    assert rows(t.read(), "eps", "rating") == [(5.0, None), (5.0, None)]


def test_upsert_opens_only_touched_files(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "FILE_ROWS", 10)
    t = table(spark)
    many = [(f"S{i:03d}", f"{y}-01-05", 1.0) for i in range(30) for y in (2020, 2021, 2022)]
    t.upsert(factors(spark, many))
    files = t.files().count()
    assert files >= 9
    opened = []
    own = SnapshotTable._open
    monkeypatch.setattr(SnapshotTable, "_open", lambda self, f: opened.append({r.path for r in f}) or own(self, f))
    t.upsert(factors(spark, [("S012", "2021-01-05", 5.0), ("S013", "2021-01-05", 5.0)]))
    stored = opened[0]  # the base side; the other calls open the batch's own files
    assert 1 <= len(stored) <= 2 and all("slot=2021" in p for p in stored)
    assert t.read().count() == 90 and t.read().where("adj_factor = 5").count() == 2
    # a symbol and a year: one file of many
    one = t.read(["S010"], "2020-01-01", "2020-12-31")
    assert len(one.inputFiles()) == 1 and rows(one) == [("S010", dt.date(2020, 1, 5), 1.0)]
    assert t.read(["S010"]).count() == 3 and t.read(["none"]).count() == 0


def test_marks_equal_a_scan_after_every_load(spark):
    t = table(spark)
    for n, batch in enumerate([FIRST, [("C", "2019-01-01", 1.0)], [("A", "2022-01-01", 3.0), ("B", "2025-02-02", 3.0)]]):
        t.upsert(factors(spark, batch), batch_id=(f"w{n % 2}", n))
        scan = rows(t.read().groupBy("ts_code").agg(F.max("trade_date").cast("string").alias("m")), "ts_code", "m")
        assert rows(t.marks().where("kind = 'symbol'"), "key", "mark") == scan
        assert rows(t.marks().where("kind = 'table'"), "key", "mark") == [("adj_factor", max(m for _, m in scan))]
    before = rows(t.marks())
    t.rebuild_marks()
    assert rows(t.marks()) == before and t.read().count() == 6


def test_slot_must_come_from_the_key(spark):
    with pytest.raises(ValueError, match="key columns"):
        SnapshotTable(spark, staging_path(spark, "t-slot"), replace(SPECS["daily"], slot="year(trade_date) + close"))
    with pytest.raises(ValueError):
        SnapshotTable(spark, staging_path(spark, "t-slot"), replace(SPECS["daily"], keys=("nope",)))


def test_every_declared_table_can_be_loaded(spark):
    root = staging_path(spark, "t-all")
    out = load_market(spark, root, {n: spark.createDataFrame([], s.schema) for n, s in SPECS.items()}, "empty")
    assert {n: t.read().columns for n, t in out.items()} == {n: s.columns for n, s in SPECS.items()}


def test_vacuum_keeps_what_later_versions_list(spark):
    t = table(spark)
    for day in range(1, 5):
        t.upsert(factors(spark, [("A", f"2023-01-0{day}", 1.0), ("A", "2024-01-01", float(day))]))
    want = content(t)
    assert t.vacuum(1) > 0 and content(t) == want and t.vacuum(1) == 0


def test_failed_folder_swap_is_mended(spark, monkeypatch):
    for part in (None, "part"):
        path = staging_path(spark, "t-swap")
        base = bars(spark, [("A", "2024-01-01", 1.0, 1.0), ("B", "2024-01-02", 2.0, 1.0)]).withColumn("part", F.lit("p"))
        upsert_to_path(spark, path, base, ["ts_code", "trade_date"], ["vol"], part)
        calls = []
        own = merge._move

        def once(*a):
            calls.append(a)
            if len(calls) == 2:  # the old folder is aside, the new one not yet in its place
                raise OSError("gone")
            own(*a)

        batch = bars(spark, [("A", "2024-01-01", 9.0, 2.0)]).withColumn("part", F.lit("p"))
        with monkeypatch.context() as m:
            m.setattr(merge, "_move", once)
            with pytest.raises(OSError):
                upsert_to_path(spark, path, batch, ["ts_code", "trade_date"], ["vol"], part)
        out = upsert_to_path(spark, path, batch, ["ts_code", "trade_date"], ["vol"], part)
        assert rows(out, "ts_code", "close") == [("A", 9.0), ("B", 2.0)]


def test_partition_in_the_key_needs_no_scan_of_the_stored_keys(spark, monkeypatch):
    path = staging_path(spark, "t-noscan")
    schema = "k string, part string, ts int"
    upsert_to_path(spark, path, spark.createDataFrame([("a", "p1", 1), ("b", "p2", 1)], schema), ["k", "part"], ["ts"], "part")
    semis = []
    own = merge._on_keys
    monkeypatch.setattr(merge, "_on_keys", lambda df, keys, key_rows, how: semis.append(how) or own(df, keys, key_rows, how))
    out = upsert_to_path(spark, path, spark.createDataFrame([("a", "p1", 2)], schema), ["k", "part"], ["ts"], "part")
    assert semis == ["left_anti"] and rows(out, "k", "ts") == [("a", 2), ("b", 1)]


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("rule", ["upsert", "newest", "absent"])
def test_rows_laid_out_once_merge_like_the_joins(spark, rule):
    """NULL keys, repeated keys in the batch and (as appends leave them) in the table; one shuffle in all."""
    schema = "k string, part string, ts int, v int"
    base = spark.createDataFrame([("a", "p", 5, 1), ("a", "p", 1, 2), (None, "p", 1, 3), ("c", None, 1, 4), ("d", "p", None, 5),
                                  ("e", "p", 1, 6), ("e", "p", 1, 6)], schema)
    batch = spark.createDataFrame([("a", "p", 3, 7), ("a", "p", 3, 8), (None, "p", None, 9), ("c", None, 2, 10), ("c", None, 1, 11),
                                   ("n", "p", None, 12), ("n", "p", 0, 13)], schema)
    for order in (["ts"], [F.col("ts") * 2], []):
        both = base.withColumn(merge.NEW, F.lit(False)).unionByName(batch.withColumn(merge.NEW, F.lit(True)))
        laid = both.withColumn("slot", F.coalesce("part", F.lit(""))).repartitionByRange("slot", "k")
        got = merge.merge_laid(laid, ["slot"], ["k", "part"], order, rule)
        assert _exchanges(got) == 1
        want = (merge.insert_absent(base, batch, ["k", "part"], order) if rule == "absent" else
                merge.upsert_merge(base, batch, ["k", "part"], order, newest_wins=rule == "newest"))
        assert rows(got, *want.columns) == rows(want)


def test_a_batch_of_many_rows_of_one_key_is_combined_first(spark, monkeypatch):
    combined = []
    own = snapshots.latest_per_key
    monkeypatch.setattr(snapshots, "latest_per_key", lambda *a: combined.append(a) or own(*a))
    t = table(spark)
    t.upsert(factors(spark, [("A", f"2023-05-{d:02d}", 1.0) for d in range(1, 21)]))
    assert not combined
    t.upsert(factors(spark, [("A", "2023-05-01", float(n)) for n in range(50)]))
    assert len(combined) == 1 and t.read().count() == 20 and rows(t.read().where("adj_factor > 1"), "adj_factor") == [(49.0,)]
