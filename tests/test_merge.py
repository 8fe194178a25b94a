"""Keyed writes: idempotence, replace-on-conflict, schema tolerance, NULL keys, batch duplicates."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from tidemark.operators.merge import (align_schema, insert_absent, latest_per_key, upsert_counts, upsert_merge,
                                      upsert_to_path)
from tidemark.session import staging_path
from tidemark.sources.schemas import spec

BAR = "ts_code string, trade_date date, close double, vol double"


def _bars(spark, data):
    return spark.createDataFrame(data, BAR)


D1, D2, D3 = dt.date(2024, 1, 2), dt.date(2024, 1, 3), dt.date(2024, 1, 4)


def test_upsert_is_idempotent(spark):
    base = _bars(spark, [("A", D1, 10.0, 1.0), ("B", D1, 20.0, 2.0)])
    batch = _bars(spark, [("A", D2, 11.0, 1.0), ("B", D1, 21.0, 3.0)])
    once = upsert_merge(base, batch, ["ts_code", "trade_date"], ["vol"])
    twice = upsert_merge(once, batch, ["ts_code", "trade_date"], ["vol"])
    assert rows(once) == rows(twice)
    assert once.count() == 3


def test_conflict_replaces_non_key_columns(spark):
    base = _bars(spark, [("A", D1, 10.0, 1.0)])
    batch = _bars(spark, [("A", D1, 99.0, 5.0)])
    assert rows(upsert_merge(base, batch, ["ts_code", "trade_date"], ["vol"])) == [("A", D1, 99.0, 5.0)]


def test_duplicate_key_in_batch_highest_order_wins(spark):
    base = _bars(spark, [])
    batch = _bars(spark, [("A", D1, 1.0, 1.0), ("A", D1, 2.0, 7.0), ("A", D1, 3.0, 4.0)])
    out = upsert_merge(base, batch, ["ts_code", "trade_date"], ["vol"])
    assert rows(out) == [("A", D1, 2.0, 7.0)]


def test_null_key_part_is_one_key(spark):
    schema = "ts_code string, report_date date, org_name string, author_name string, quarter string, eps double"
    base = spark.createDataFrame([("A", D1, "X", None, "2024Q1", 1.0)], schema)
    batch = spark.createDataFrame([("A", D1, "X", None, "2024Q1", 2.0)], schema)
    keys = ["ts_code", "report_date", "org_name", "author_name", "quarter"]
    out = upsert_merge(base, batch, keys, ["eps"])
    assert rows(out) == [("A", D1, "X", None, "2024Q1", 2.0)]
    assert rows(insert_absent(base, batch, keys)) == [("A", D1, "X", None, "2024Q1", 1.0)]


def test_same_key_except_last_part_kept(spark):
    schema = "ts_code string, surv_date date, rece_org string, note string"
    base = spark.createDataFrame([("A", D1, "org1", "a")], schema)
    batch = spark.createDataFrame([("A", D1, "org2", "b")], schema)
    assert upsert_merge(base, batch, ["ts_code", "surv_date", "rece_org"], ["note"]).count() == 2


def test_upsert_counts_are_keys_not_batch_length(spark):
    base = _bars(spark, [("A", D1, 10.0, 1.0)])
    batch = _bars(spark, [("A", D1, 11.0, 1.0), ("A", D1, 12.0, 2.0), ("B", D1, 1.0, 1.0)])
    r = upsert_counts(base, batch, ["ts_code", "trade_date"]).collect()[0]
    assert (r["inserted"], r["updated"]) == (1, 1)


def test_align_schema_drops_unknown_and_fills_missing(spark):
    df = spark.createDataFrame([("A.SH", "Alpha", "x", 1)], "ts_code string, name string, junk string, extra int")
    aligned, dropped = align_schema(df, spec("stock_basic").schema)
    assert aligned.columns == spec("stock_basic").columns
    assert sorted(dropped) == ["extra", "junk"]
    r = aligned.collect()[0]
    assert r["ts_code"] == "A.SH" and r["industry"] is None and r["list_date"] is None


def test_latest_per_key_requires_order(spark):
    import pytest

    with pytest.raises(ValueError):
        latest_per_key(_bars(spark, []), ["ts_code"], [])


def test_upsert_to_path_rewrites_only_touched_partitions(spark):
    import glob
    import os

    path = staging_path(spark, "t-upsert").replace("file:", "")
    base = _bars(spark, [("A", D1, 1.0, 1.0), ("B", D2, 2.0, 1.0), ("C", D3, 3.0, 1.0)]) \
        .withColumn("part", F.date_format("trade_date", "yyyyMMdd"))
    upsert_to_path(spark, path, base, ["ts_code", "trade_date"], ["vol"], "part")
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{path}/part=*/*.parquet")}
    batch = _bars(spark, [("A", D1, 9.0, 2.0), ("D", D1, 4.0, 1.0)]).withColumn("part", F.lit("20240102"))
    out = upsert_to_path(spark, path, batch, ["ts_code", "trade_date"], ["vol"], "part")
    assert out.count() == 4
    after = {p: os.path.getmtime(p) for p in glob.glob(f"{path}/part=*/*.parquet")}
    untouched = [p for p in before if "part=20240102" not in p]
    assert untouched and all(p in after and after[p] == before[p] for p in untouched)
    assert rows(out.where("ts_code = 'A'"), "close") == [(9.0,)]
    # replaying the same batch changes nothing
    first = rows(out)
    again = upsert_to_path(spark, path, batch, ["ts_code", "trade_date"], ["vol"], "part")
    assert rows(again) == first


def test_events_upsert_matches_distinct_keys(md):
    from tidemark.plans.ingest import event_rows, upsert_merge_q
    out = upsert_merge_q(md)
    keys = event_rows(md).select("user_id", "event_type", "day").distinct().count()
    assert out.count() == keys


def test_unknown_key_is_rejected(spark):
    import pytest

    with pytest.raises(ValueError):
        upsert_merge(_bars(spark, []), _bars(spark, []), ["ts_code", "nope"], ["vol"])


def test_watchlist_sink_roundtrip(spark, md):
    from tidemark.plans.watchlist import watchlist_tags, write_watchlist
    path = staging_path(spark, "t-watch")
    tags = watchlist_tags(md)
    write_watchlist(tags, path)
    back = spark.read.json(path)
    assert back.count() == tags.count()
    r = back.orderBy("ts_code").first()
    assert r["tags"] == sorted(r["tags"])


def test_init_tables_declared_schemas(spark):
    from tidemark.sources.schemas import SPECS, init_tables
    root = staging_path(spark, "t-init")
    paths = init_tables(spark, root, ["daily", "trade_cal"])
    for n, p in paths.items():
        df = spark.read.parquet(p)
        assert df.count() == 0 and df.columns == SPECS[n].columns


def test_split_detail_keeps_only_non_empty_text(spark):
    from tidemark.operators.ingest import split_detail
    df = spark.createDataFrame([("A", D1, "o1", "text"), ("A", D1, "o2", ""), ("A", D1, "o3", None)],
                               "ts_code string, surv_date date, rece_org string, content string")
    narrow, detail = split_detail(df, ["ts_code", "surv_date", "rece_org"], "content")
    assert narrow.count() == 3 and "content" not in narrow.columns
    assert rows(detail) == [("A", D1, "o1", "text")]


def test_concept_denorm_defaults_and_missing_members(spark):
    from tidemark.operators.ingest import concept_denorm
    q = spark.createDataFrame([("C1", D1, 1.0, 2.0, 0.5, 1.5, None, None, 10.0, 100.0),
                               ("C2", D1, 1.0, 2.0, 0.5, 1.5, None, None, 10.0, 100.0)],
                              "index_code string, trade_date date, open double, high double, low double, "
                              "close double, pre_close double, pct_chg double, vol double, amount double")
    meta = spark.createDataFrame([("C1", "One", "T")], "index_code string, index_name string, index_type string")
    mem = spark.createDataFrame([("C1", "P1", "p1"), ("C1", "P2", "p2"), ("C2", "P3", "p3")],
                                "index_code string, ts_code string, name string")
    out = concept_denorm(q, mem, meta)
    assert out.count() == 3
    assert {r["index_name"] for r in out.where("index_code = 'C2'").collect()} == {""}
    no_members = concept_denorm(q, None, meta).collect()
    assert len(no_members) == 2 and all(r["ts_code"] is None for r in no_members)


def test_concept_denorm_keeps_quotes_without_a_date(spark):
    from tidemark.operators.ingest import concept_denorm, join_row_count
    q = spark.createDataFrame([("C1", d, 1.0, 2.0, 0.5, 1.5, None, None, 10.0, 100.0) for d in (D1, None, None)],
                              "index_code string, trade_date date, open double, high double, low double, "
                              "close double, pre_close double, pct_chg double, vol double, amount double")
    meta = spark.createDataFrame([("C1", "One", "T")], "index_code string, index_name string, index_type string")
    mem = spark.createDataFrame([("C1", "P1", "p1"), ("C1", "P2", "p2")], "index_code string, ts_code string, name string")
    out = concept_denorm(q, mem, meta)
    assert rows(out, "trade_date", "ts_code") == sorted([(d, p) for d in (D1, None, None) for p in ("P1", "P2")], key=repr)
    assert out.count() == join_row_count(q, mem, "index_code").first()["rows"]


def test_upsert_leaves_no_key_in_another_partition(spark):
    path = staging_path(spark, "t-moved")
    schema = "k string, ts int, part string"
    upsert_to_path(spark, path, spark.createDataFrame([("a", 1, "p1"), ("b", 1, "p3"), ("c", 1, "p1")], schema), ["k"], ["ts"], "part")
    out = upsert_to_path(spark, path, spark.createDataFrame([("a", 2, "p2"), ("b", 2, "p2")], schema), ["k"], ["ts"], "part")
    assert rows(out, "k", "ts", "part") == [("a", 2, "p2"), ("b", 2, "p2"), ("c", 1, "p1")]


def test_older_replay_does_not_beat_a_newer_row(spark):
    schema = "k string, ts int, v string"
    base = spark.createDataFrame([("a", 2, "new"), (None, 1, "x")], schema)
    old = spark.createDataFrame([("a", 1, "old"), (None, 3, "y"), ("b", 0, "late")], schema)
    assert rows(upsert_merge(base, old, ["k"], ["ts"], newest_wins=True)) == rows(
        spark.createDataFrame([("a", 2, "new"), (None, 3, "y"), ("b", 0, "late")], schema))


def test_insert_absent_has_a_stated_winner(spark):
    schema = "k string, ts int, v string"
    base = spark.createDataFrame([("a", 1, "x")], schema)
    batch = spark.createDataFrame([("b", 1, "p"), ("b", 2, "q"), ("a", 9, "z")], schema)
    assert rows(insert_absent(base, batch, ["k"], ["ts"])) == [("a", 1, "x"), ("b", 2, "q")]


def test_open_and_close_order_is_exact_for_any_price(spark):
    from tidemark.sources.bindings import _bar_order
    df = spark.createDataFrame([(1, 100, 5, 2_000_000.0), (1, 100, 6, 1.0), (1, 99, None, 3.0)],
                               "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double")
    r = df.agg(F.min_by("l_extendedprice", _bar_order()).alias("open"), F.max_by("l_extendedprice", _bar_order()).alias("close")).first()
    assert (r.open, r.close) == (3.0, 1.0)
