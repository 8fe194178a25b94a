"""Physical-plan properties the scale design relies on."""

from tidemark.operators.merge import latest_per_key


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_per_key_combines_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS ts", "cast(id AS string) AS v")
    p = _plan(latest_per_key(df, ["k"], ["ts"]))
    assert "partial_max" in p  # map-side combine: a hot key never arrives whole in one task


def test_bars_combine_before_the_shuffle(md):
    p = _plan(md.bars())
    assert "partial_min_by" in p and "partial_max_by" in p


def test_concept_fan_out_is_keyed_by_concept_and_month_without_a_hint(md):
    df = md.ths_index()
    assert "__month" in _plan(df) and "ResolvedHint" not in df._jdf.queryExecution().analyzed().toString().split("Join Inner")[0]


def test_upsert_aggregates_only_the_batch(spark):
    from tidemark.operators.merge import upsert_merge
    base = spark.range(1000).selectExpr("id AS k", "id AS ts")
    p = _plan(upsert_merge(base, spark.range(5).selectExpr("id AS k", "id AS ts"), ["k"], ["ts"]))
    assert "LeftAnti" in p


def test_top_k_limits_before_the_shuffle(md):
    from tidemark.plans.picks import broker_rank
    p = _plan(broker_rank(md))
    assert "WindowGroupLimit" in p


def test_scan_prunes_columns(md):
    p = _plan(md.adj_factor())
    assert "ReadSchema: struct<l_suppkey:bigint,l_discount:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in p
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in p


def test_factor_table_has_261_columns_and_a_subset_reads_only_its_own(spark, md):
    from conftest import rows
    from tidemark.plans.market import INDICATOR_COLS, factors_all, indicator_subset
    from tidemark.session import staging_path
    from tidemark.sources.schemas import SPECS
    from tidemark.sources.snapshots import SnapshotTable

    spec = SPECS["stk_factor_pro"]
    assert len(spec.columns) == 261 and factors_all(md).columns == [*spec.columns, "position"]
    table = SnapshotTable(spark, staging_path(spark, "t-factors"), spec)
    table.replace(md.stk_factor_pro().where("ts_code IN ('S1', 'S2')"))
    stored = table.read().select("ts_code", *INDICATOR_COLS)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        read = _plan(stored).split("ReadSchema: struct<")[1].split(">")[0]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert len(read.split(",")) == 18 and "xsii" not in read  # 17 columns and the symbol
    assert rows(stored) == rows(indicator_subset(md).where("ts_code IN ('S1', 'S2')"))
    assert "xsii" not in _plan(indicator_subset(md))


def test_statistics_need_no_expand(md):
    from tidemark.plans.stats import table_overview, table_stats

    assert "Expand" not in _plan(table_stats(md)) and "Expand" not in _plan(table_overview(md))
    assert "bit_count" in table_stats(md)._jdf.queryExecution().optimizedPlan().toString()


def test_sql_calls_on_different_data_run_side_by_side(spark, md):
    from concurrent.futures import ThreadPoolExecutor

    import pytest
    from tidemark.plans.market import sql
    from tidemark.sources.bindings import MarketData

    other = MarketData(spark, "/root/testdata/sf0.01")
    text = "SELECT count(*) AS n FROM {stock_basic} WHERE ts_code <> :skip"
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda m: sql(m, text, skip="S1").first()["n"], [md, other] * 8))
    want = [m.stock_basic().where("ts_code <> 'S1'").count() for m in (md, other)]
    assert got == want * 8 and want[0] != want[1]
    with pytest.raises(ValueError, match="no such table"):
        sql(md, "SELECT * FROM {nothing}")


def test_positions_follow_the_order_and_limits_cut(spark):
    from pyspark.sql import functions as F
    from tidemark.operators.ordering import with_position

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("v")).repartition(7)
    got = sorted((r.position, r.k) for r in with_position(df, [F.col("k").desc()]).collect())
    assert got == [(i + 1, 4999 - i) for i in range(5000)]
    assert sorted(r.position for r in with_position(df, ["v", "k"], 10).collect()) == list(range(1, 11))
    assert with_position(df.where("false"), ["k"]).count() == 0


def test_landing_writes_one_file_per_partition(spark):
    import glob

    from pyspark.sql import functions as F
    from tidemark.session import staging_path
    from tidemark.sources.landing import write_landing

    path = write_landing(spark.range(1000).withColumn("m", F.col("id") % 5).repartition(8), staging_path(spark, "t-land"), partition_by="m")
    assert all(len(glob.glob(f"{path.removeprefix('file:')}/m={k}/*.parquet")) == 1 for k in range(5))


def test_bars_shuffle_the_lines_as_they_are(spark, tmp_path):
    """The bars of a symbol and day: lines go through one shuffle and are aggregated after it, in either table."""
    import datetime as dt

    from conftest import rows
    from tidemark.sources.bindings import MarketData
    t = dt.datetime(2024, 1, 2, 10)
    lines = [(2, 7, 1, 1, 1.0, 20.0, 0.1, 0.02, t), (1, 7, 1, 2, 2.0, 10.0, 0.3, 0.01, t), (3, 7, 1, 1, 4.0, 30.0, 0.2, 0.04, t),
             (3, 7, 1, 1, 4.0, 30.0, 0.2, 0.04, t), (9, 7, None, 1, 5.0, None, None, None, t), (9, 7, None, 1, 5.0, 8.0, None, None, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                 "l_discount double, l_tax double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    md = MarketData(spark, str(tmp_path))
    for df in (md.bars(), md.daily_basic()):
        plan = _plan(df)
        below = plan[plan.rindex("Exchange "):]
        assert plan.count("Exchange ") == 1 and "Aggregate" not in below
    day = dt.date(2024, 1, 2)
    assert rows(md.bars()) == sorted([("S1", day, 10.0, 30.0, 10.0, 30.0, 11.0, 90.0), (None, day, None, None, None, None, 5.0, None),
                                      (None, None, 8.0, 8.0, 8.0, 8.0, 5.0, 8.0)], key=repr)
    assert rows(md.daily_basic().where("ts_code = 'S1'"), "close", "turnover_rate", "volume_ratio", "pe", "pb", "ps", "total_mv") == [
        (30.0, 0.3, 4.0, 1.0, 0.04, 0.01, 90.0)]
