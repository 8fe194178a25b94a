"""Shared helpers of the corpus operators: staged tables, Arrow plumbing, 64-bit hashes."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import staging_path

#: ASCII letters A-Z lower-cased by the SQL side; nothing else changes case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six ASCII white-space characters, as Java regex class members.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder of spark.checkpoint.dir and read it back; ``file_rows``: rows of a file at most.

    Cuts the lineage: a lost executor costs its running tasks, never an earlier step.
    """
    spark = df.sparkSession
    path = staging_path(spark, label)
    writer = df.write.mode("errorifexists")
    (writer.option("maxRecordsPerFile", file_rows) if file_rows else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    for v in column.cast(pa.large_binary()):
        yield v.as_py() or b""


def worker_cache(kind: str, mark: Hashable, build: Callable):
    """One object of a kind per Python worker, shared by its tasks until one comes with another mark."""
    held = sys.modules.setdefault("tidemark_worker_cache", types.ModuleType("tidemark_worker_cache")).__dict__
    if held.get(kind, (None, None))[0] != mark:
        held[kind] = mark, build()
    return held[kind][1]


class WordHash(dict):
    """word -> 64-bit hash, remembering at most ``keep`` words per worker."""

    def __init__(self, keep: int = 400_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (splitmix)."""
    z = z ^ (z >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z = z ^ (z >> np.uint64(27))
    z = z * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())


def list_of_longs(matrix: np.ndarray) -> pa.Array:
    """(rows, width) uint64 matrix as array<bigint>."""
    n, w = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * w, w, dtype=np.int32)), longs(matrix.reshape(-1)))


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def arrow_map(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A mapInArrow function from a per-batch one."""

    def run(batches):
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return run
