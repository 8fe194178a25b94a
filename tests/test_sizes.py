"""Work is spread by its size, not by the bytes or the keys that go in."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.session import INITIAL_PARTITIONS, apply_sql_defaults


def test_concept_rows_of_one_concept_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ingest, "TASK_ROWS", 2000, raising=False)
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    price = [F.col("id").cast("double").alias(c) for c in ("open", "high", "low", "close", "pre_close", "pct_chg", "vol", "amount")]
    quotes = spark.range(40).select(F.lit("A").alias("index_code"), day.alias("trade_date"), *price)
    twice = F.explode(F.array(F.lit(1), F.lit(2)))  # a member that comes twice gives its rows twice
    members = spark.range(500).select(F.lit("A").alias("index_code"), F.nullif(F.col("id"), F.lit(7)).cast("string").alias("ts_code"),
                                      F.lit("n").alias("name"), twice).drop("col")
    meta = spark.range(1).select(F.lit("A").alias("index_code"), F.lit("Concept A").alias("index_name"), F.lit("t").alias("index_type"))
    out = ingest.concept_denorm(quotes, members, meta)
    tasks = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(tasks) == 40 * 1000 and len(tasks) > 4 and max(tasks) < 40 * 1000 / 2
    per = out.groupBy("ts_code").agg(F.count("*").alias("n"), F.count_distinct("trade_date").alias("days"))
    assert per.where("n = 80 AND days = 40").count() == 500


def _concepts(spark, concepts, days, members):
    """Quotes, members and names of concepts that have as many days and members each."""
    i = F.col("id")
    code = F.concat(F.lit("C"), (i % concepts).cast("string")).alias("index_code")
    n = F.floor(i / concepts).cast("int")
    price = [i.cast("double").alias(c) for c in ("open", "high", "low", "close", "pre_close", "pct_chg", "vol", "amount")]
    quotes = spark.range(concepts * days).select(code, F.date_add(F.lit("2024-01-01").cast("date"), n).alias("trade_date"), *price)
    names = spark.range(concepts * members).select(code, F.concat(F.lit("P"), i.cast("string")).alias("ts_code"), F.lit("n").alias("name"))
    return quotes, names, spark.range(concepts).select(code, F.lit("Concept").alias("index_name"), F.lit("t").alias("index_type"))


def test_quotes_are_repeated_for_the_parts_of_their_own_concept_only(spark, monkeypatch):
    monkeypatch.setattr(ingest, "TASK_ROWS", 2000)
    quotes, members, meta = _concepts(spark, 50, 40, 10)  # 11 tasks, no concept has more rows than one of them
    frame, dealt = type(quotes), []
    deal = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: dealt.append(self.count()) or deal(self, *a))
    out = ingest.concept_denorm(quotes, members, meta)
    assert sum(dealt) == 50 * 2 + 50 * 10  # two months of quotes and the members
    assert out.count() == out.distinct().count() == 50 * 40 * 10


def test_rows_of_a_quote_stand_together(spark):
    quotes, members, meta = _concepts(spark, 3, 40, 200)
    rows = ingest.concept_denorm(quotes, members, meta).select("index_code", "trade_date", "ts_code").collect()
    assert len(rows) == len(set(rows)) == 3 * 40 * 200
    changes = sum(a[:2] != b[:2] for a, b in zip(rows, rows[1:], strict=False))
    assert changes < 3 * 40 * 2  # a written result has runs instead of a value a row


def test_members_and_days_are_chosen_before_they_meet(spark, monkeypatch):
    from tidemark.plans.market import concept_rows
    quotes, members, meta = _concepts(spark, 3, 40, 20)
    seen, join = [], ingest.concept_denorm
    monkeypatch.setattr(ingest, "concept_denorm", lambda q, m, *a: seen.extend([q, m]) or join(q, m, *a))
    md = SimpleNamespace(concept_quotes=lambda: quotes, concept_members=lambda: members, concept_meta=lambda: meta,
                         ths_index=lambda: ingest.concept_denorm(quotes, members, meta))
    out = concept_rows(md, index_code="C1", ts_code="P4", index_name="Conc", start="2024-01-05", end="2024-01-09")
    assert [df.count() for df in seen] == [5, 1]
    assert sorted((r.index_code, r.ts_code, r.trade_date.day) for r in out.collect()) == [("C1", "P4", d) for d in range(5, 10)]
    assert concept_rows(md, index_name="no such name").count() == 0


def test_empty_concepts(spark):
    meta = spark.createDataFrame([], "index_code string, index_name string, index_type string")
    quotes = spark.createDataFrame([], "index_code string, trade_date date, open double, high double, low double, close double, "
                                       "pre_close double, pct_chg double, vol double, amount double")
    members = spark.createDataFrame([], "index_code string, ts_code string, name string")
    assert ingest.concept_denorm(quotes, members, meta).count() == 0


def test_shuffles_part_by_their_bytes(spark):
    """With one shuffle partition asked for, a large shuffle still ends in as many tasks as its bytes need."""
    name, _ = INITIAL_PARTITIONS
    small = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "5k"}
    before = {k: spark.conf.get(k, None) for k in (*small, name)}
    try:
        spark.conf.unset(name)
        for k, v in small.items():
            spark.conf.set(k, v)
        apply_sql_defaults(spark)
        rows = spark.range(200_000).groupBy(F.xxhash64("id").alias("k")).agg(F.count("*").alias("n"))
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 4
        spark.conf.set(name, "7")
        apply_sql_defaults(spark)
        assert spark.conf.get(name) == "7"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tasks_read_at_most_their_size_unless_the_session_says_otherwise(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        apply_sql_defaults(spark)
        assert spark.conf.get(name) == "32m"
        spark.conf.set(name, "5m")
        apply_sql_defaults(spark)
        assert spark.conf.get(name) == "5m"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
