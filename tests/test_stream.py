"""Streaming upsert: replay safety; landing reads prune partitions."""

from pyspark.sql import functions as F

from conftest import rows
from tidemark.plans.ingest import EVENT_KEYS, event_base, event_batch, upsert_merge_q
from tidemark.session import staging_path
from tidemark.streaming.upsert_stream import start_upsert_stream


def _run(spark, md, target, landing):
    q = start_upsert_stream(spark, landing, event_batch(md).schema, target, EVENT_KEYS, ["ts"], partition_col="day",
                            checkpoint=staging_path(spark, "t-ckpt"))
    q.awaitTermination()
    return spark.read.parquet(target)


def test_stream_upsert_equals_batch_upsert_and_replay_is_idempotent(spark, md):
    target = staging_path(spark, "t-target")
    event_base(md).write.mode("overwrite").partitionBy("day").parquet(target)
    landing = staging_path(spark, "t-landing")
    event_batch(md).write.mode("overwrite").parquet(landing)
    cols = ["user_id", "event_type", "day", "ts", "value", "event_id"]
    first = rows(_run(spark, md, target, landing), *cols)
    assert first == rows(upsert_merge_q(md), *cols)
    # a fresh checkpoint replays every file: the table must not change
    again = rows(_run(spark, md, target, landing), *cols)
    assert again == first


def test_landing_dates_prune_partitions(spark, md):
    from tidemark.plans.io import landing_read_dates
    df = landing_read_dates(md)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters: [isnotnull" in plan
    assert df.count() == md.bars().join(
        md.trade_cal().where("exchange = 'ASIA' AND is_open AND year(cal_date) = 1996")
        .select(F.col("cal_date").alias("trade_date")), "trade_date", "left_semi").count()
