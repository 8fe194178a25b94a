"""Landing-file stream -> keyed, idempotent upsert of a table.

``readStream`` over the landing directory (declared schema), each micro-batch reduced to one row
per key and merged. The merge keeps the greatest ``order_by`` per key, stored rows included, so neither
a replayed nor a late micro-batch can replace a newer row and late rows of new keys are still stored.
The stream itself keeps no state. Into a ``SnapshotTable`` every micro-batch is one version, opens only
the files that its keys fall into and is applied once per (stream, epoch).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.operators.merge import latest_per_key, upsert_to_path
from tidemark.session import staging_path
from tidemark.sources.snapshots import SnapshotTable


def start_upsert_stream(spark: SparkSession, landing: str, schema: T.StructType, target: str | SnapshotTable,
                        keys: Sequence[str], order_by: Sequence[str], checkpoint: str | None = None,
                        partition_col: str | None = None, available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``."""
    keys, order_by = list(keys), list(order_by)
    checkpoint = checkpoint or staging_path(spark, "stream-ckpt")
    src = spark.readStream.schema(schema).parquet(landing)

    def merge_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if isinstance(target, SnapshotTable):
            target.upsert(batch, order_by, newest_wins=True, batch_id=(checkpoint, epoch))  # epochs are counted per checkpoint
            return
        once = staging_path(spark, "stream-batch")  # read more than once below
        latest_per_key(batch, keys, order_by).write.parquet(once)
        upsert_to_path(spark, target, spark.read.schema(batch.schema).parquet(once), keys, order_by, partition_col, newest_wins=True)

    w = (src.writeStream.foreachBatch(merge_batch)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
