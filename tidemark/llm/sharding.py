"""Sharding by jump consistent hashing: key and shard count decide, no ring table.

Growing from n to n+1 shards moves about 1/(n+1) of the keys, all of them into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 8
#: Parts of a shard that are numbered apart; a shard's rows never meet in one task.
SLOT_BUCKETS = 4096


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard (0 .. shards-1) of each 64-bit key: the last jump of its pseudo-random walk below ``shards``."""
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = ahead[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            ahead[live] = np.minimum((at[live] + 1) * step, float(1 << 62)).astype(np.int64)
            live = live[ahead[live] < shards]
    return at


def shard_of(shards: int, *key: str | Column) -> Column:
    """The shard of a row by a stable hash of its key columns; a null key is a key of its own."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def pick(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy().view(np.uint64), shards).astype(np.int32))

    return pick(F.xxhash64(*key))


def place(df: DataFrame, key: list[str], identity: list[str], shards: int = SHARDS) -> DataFrame:
    """``identity`` columns of each row with shard, slot and grown_shard.

    ``key`` (a part of ``identity``) decides the shard; slots run gapless from 0 in each shard.
    Rows equal in ``identity`` are numbered as one weighted row and written out again, so neither a
    repeated row nor a hot key is gathered; a shard is numbered in SLOT_BUCKETS parts whose starts
    come from their counts. Null keys share a shard. An empty table gives no rows.
    """
    rows = (df.groupBy(*identity).agg(F.count("*").alias("_n"))
            .withColumn("shard", shard_of(shards, *key)).withColumn("grown_shard", shard_of(shards + 1, *key))
            .withColumn("_part", F.pmod(F.xxhash64(F.lit(7), *identity), F.lit(SLOT_BUCKETS)).cast("int")))
    part = rows.groupBy("shard", "_part").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.select("shard", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_part").orderBy(*identity).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
            .join(starts, ["shard", "_part"])
            .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
            .withColumn("slot", F.col("_start") + F.col("_at") + F.col("_copy"))
            .drop("_n", "_part", "_at", "_start", "_copy"))


def write_shards(df: DataFrame, path: str, *key: str, shards: int = SHARDS) -> None:
    """Write whole rows under ``path``/shard=K; each task writes what it has, so a hot key stays spread."""
    df.withColumn("shard", shard_of(shards, *key)).write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row (doc_id, text; others unused).

    Null text counts as no bytes (size 1, crc 0). A repeated doc_id goes to one shard with all its rows.
    """
    body = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"))
    placed = place(rows, ["doc_id"], ["doc_id", "size", "text_crc32"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARDS)
