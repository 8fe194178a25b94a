"""Keyed tables published as snapshots.

A table is a folder with immutable data files, one folder per version that lists the files it consists
of, and one pointer file that names the current version and is swapped last:

    data/<batch>/slot=<partition>/part-*.parquet      never changed once written
    versions/<n>/files                                slot, path, rows, key range and date range of every file
    versions/<n>/marks                                high-water marks and applied batches: (kind, key, mark)
    batches/<id>                                      a batch while it is merged
    CURRENT                                           n

Readers resolve the pointer once and see that version whole. A write that fails anywhere before the
swap leaves the old version as it is; its files are overwritten or ignored by the next one. One writer
per table at a time.

The partition (slot) of a row is an expression over key columns, so a key never moves: an upsert opens
only the files of the slots and key ranges that the batch falls into, and no scan of the stored keys
is needed. Data are written range-partitioned on (slot, first key), so a file holds a narrow key range
and a read for a symbol and a year opens one file of many.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.merge import NEW, align_schema, latest_per_key, merge_laid
from tidemark.sources.schemas import SPECS, TableSpec

FILES = "slot string, path string, rows long, first string, last string, low string, high string"
#: A batch is named, or numbered by its writer in ascending order (a stream's epochs).
BatchId = str | tuple[str, int]
MARKS = "kind string, key string, mark string"
#: Rows per data file; more files than that serve a slot with more rows.
FILE_ROWS = 5_000_000


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_pointer(spark: SparkSession, root: str) -> int | None:
    """The current version of the table at ``root``, or None before the first one."""
    at, fs = _hadoop(spark, f"{root}/CURRENT")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return int(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def swap_pointer(spark: SparkSession, root: str, version: int) -> None:
    """Make ``version`` the current one: a new file is renamed over the pointer, in one step."""
    jvm = spark._jvm
    tmp, fs = _hadoop(spark, f"{root}/.CURRENT-{uuid.uuid4().hex}")
    stream = fs.create(tmp, True)
    stream.write(bytearray(str(version).encode()))
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark._sc._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(
        tmp, jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT"), over)


class SnapshotTable:
    """The table of a ``TableSpec`` at ``root``: keys, schema, slot expression and date column come from the spec."""

    def __init__(self, spark: SparkSession, root: str, spec: TableSpec):
        self.spark, self.root, self.spec = spark, root.rstrip("/"), spec
        self.keys = list(spec.validate_keys())
        probe = spark.createDataFrame([], T.StructType([spec.schema[k] for k in self.keys]))
        try:
            probe.select(F.expr(spec.slot))
        except AnalysisException as e:
            raise ValueError(f"{spec.name}: the slot {spec.slot!r} must be made of key columns {self.keys}") from e

    # -- reading -----------------------------------------------------------------------------

    def version(self) -> int | None:
        return read_pointer(self.spark, self.root)

    def files(self, version: int | None = None) -> DataFrame:
        """The data files of a version (the current one if none is given) with their ranges."""
        return self._listed("files", FILES, version)

    def marks(self, version: int | None = None) -> DataFrame:
        """(kind, key, mark): newest date per first key and of the table, and the batches applied."""
        return self._listed("marks", MARKS, version)

    def _listed(self, what: str, schema: str, version: int | None) -> DataFrame:
        version = self.version() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/versions/{version}/{what}")

    def _open(self, files: list) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.spec.schema)
        return (self.spark.read.schema(self.spec.schema).option("recursiveFileLookup", "true")
                .parquet(*[f"{self.root}/{f.path}" for f in files]))

    def read(self, keys: Sequence[str] | None = None, start=None, end=None, version: int | None = None) -> DataFrame:
        """Rows of a version; ``keys`` (values of the first key) and the date range also choose the files."""
        files = self.files(version)
        day = self.spec.date_col
        conds = []
        if keys is not None:
            keys = list(keys)
            hit = F.lit(False)
            for k in keys:
                hit = hit | F.lit(k).between(F.col("first"), F.col("last"))
            files, conds = files.where(hit), [F.col(self.keys[0]).isin(keys)]
        if start is not None:
            files = files.where(F.col("high") >= F.lit(str(start)))
            conds.append(F.col(day) >= F.lit(str(start)).cast(self.spec.schema[day].dataType))
        if end is not None:
            files = files.where(F.col("low") <= F.lit(str(end)))
            conds.append(F.col(day) <= F.lit(str(end)).cast(self.spec.schema[day].dataType))
        out = self._open(files.collect())  # the list that a scan of these files holds anyway
        for c in conds:
            out = out.where(c)
        return out

    def applied(self, batch_id: BatchId) -> bool:
        """Whether a published version holds the batch: its name, or (writer, number) with that number or a later one."""
        kind, key, mark = self._batch_mark(batch_id)
        return not self.marks().where((F.col("kind") == kind) & (F.col("key") == key) & (F.col("mark") >= mark)).isEmpty()

    @staticmethod
    def _batch_mark(batch_id: BatchId) -> tuple[str, str, str]:
        return ("batch", batch_id, "1") if isinstance(batch_id, str) else ("writer", batch_id[0], f"{batch_id[1]:020d}")

    # -- writing -----------------------------------------------------------------------------

    def upsert(self, batch: DataFrame, order_by: Sequence[str | Column] = (), newest_wins: bool = False,
               batch_id: BatchId | None = None) -> int:
        """Replace the rows of the batch's keys, add new ones; returns the version (the current one if
        ``batch_id`` was applied before). Unknown columns are dropped, missing ones are NULL. Of rows with
        one key the greatest ``order_by`` wins (ties, or none given: the greatest row)."""
        return self._keyed(batch, order_by, "newest" if newest_wins else "upsert", batch_id)

    def insert_absent(self, batch: DataFrame, order_by: Sequence[str | Column] = (), batch_id: BatchId | None = None) -> int:
        """Add the rows whose key is not there yet."""
        return self._keyed(batch, order_by, "absent", batch_id)

    def append(self, batch: DataFrame, batch_id: BatchId) -> int:
        """Add the rows, once per ``batch_id``: a replayed batch adds nothing."""
        if self.applied(batch_id):
            return self.version()
        new = self._write(align_schema(batch, self.spec.schema)[0])
        return self._publish(self.files().collect(), new, self._marks(self.marks(), self._open(new), batch_id))

    def replace(self, rows: DataFrame, order_by: Sequence[str | Column] = (), batch_id: BatchId | None = None) -> int:
        """Full refresh: the given rows, one per key, become the table."""
        if batch_id is not None and self.applied(batch_id):
            return self.version()
        new = self._write(self._latest(align_schema(rows, self.spec.schema)[0], order_by))
        kept = self.marks().where("kind IN ('batch', 'writer')")
        return self._publish([], new, self._marks(kept, self._open(new), batch_id))

    def _latest(self, batch: DataFrame, order_by) -> DataFrame:
        rest = [c for c in self.spec.columns if c not in self.keys]
        return latest_per_key(batch, self.keys, list(order_by) or rest or self.keys)

    def _keyed(self, batch: DataFrame, order_by: Sequence[str | Column], rule: str, batch_id: BatchId | None) -> int:
        """The batch and the files that it touches are laid out by one shuffle and merged where they lie."""
        batch = align_schema(batch, self.spec.schema)[0]
        if batch_id is not None and self.applied(batch_id):
            return self.version()
        at = f"{self.root}/batches/{uuid.uuid4().hex}"
        batch.write.option("compression", "zstd").parquet(at)  # read more than once below
        batch = self.spark.read.schema(self.spec.schema).parquet(at)
        ranges = batch.groupBy(self._slot().alias("slot")).agg(F.min(self._first()).alias("first"), F.max(self._first()).alias("last"),
                                                                  F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64(*self.keys), 0.02).alias("n")).collect()
        files = self.files().collect()
        touched = self.touched(files, ranges)
        # a batch with many rows of one key is combined before the shuffle, so that they do not meet in one task
        repeats = sum(r.rows for r in ranges) > 1.2 * sum(r.n for r in ranges)
        new = self._latest(batch, order_by) if repeats else batch
        both = self._open(touched).withColumn(NEW, F.lit(False)).unionByName(new.withColumn(NEW, F.lit(True)))
        written = self._write(both, lambda rows: merge_laid(rows, ["slot"], self.keys, order_by, rule)) if ranges else []
        version = self._publish([f for f in files if f not in touched], written, self._marks(self.marks(), batch, batch_id))
        where, fs = _hadoop(self.spark, at)
        fs.delete(where, True)
        return version

    @staticmethod
    def touched(files: list, ranges: list) -> list:
        """The stored files that may hold a key of a batch: same slot and overlapping range of the first key."""
        of_slot = {r.slot: r for r in ranges}
        return [f for f in files if (r := of_slot.get(f.slot)) and f.first <= r.last and f.last >= r.first]

    def _slot(self) -> Column:
        return F.coalesce(F.expr(self.spec.slot).cast("string"), F.lit(""))

    def _first(self) -> Column:
        return F.coalesce(F.col(self.keys[0]).cast("string"), F.lit(""))

    def _day(self) -> Column:
        return F.col(self.spec.date_col).cast("string") if self.spec.date_col else F.lit(None).cast("string")

    def _write(self, rows: DataFrame, resolve=lambda rows: rows) -> list:
        """Write rows to new data files, ``resolve`` being applied where they lie; one row of ``FILES`` per file,
        as many as the write made."""
        at = f"data/{uuid.uuid4().hex}"
        laid = rows.withColumn("slot", self._slot()).repartitionByRange("slot", self.keys[0])
        (resolve(laid).sortWithinPartitions("slot", *self.keys)
         .write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).partitionBy("slot").parquet(f"{self.root}/{at}"))
        written = self.spark.read.schema(self.spec.schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{at}")
        path = F.regexp_extract(F.col("_metadata.file_path"), rf"{at}/.*$", 0)
        listed = (written.select(self._slot().alias("slot"), path.alias("path"), self._first().alias("k"), self._day().alias("d"))
                  .groupBy("slot", "path").agg(F.count("*").alias("rows"), F.min("k").alias("first"), F.max("k").alias("last"),
                                               F.min("d").alias("low"), F.max("d").alias("high")))
        return listed.collect()

    def marks_of(self, rows: DataFrame) -> DataFrame:
        """High-water marks of ``rows`` by a scan: the newest date per mark key and of all rows."""
        per = [(F.lit("table"), F.lit(self.spec.name))]
        if self.spec.mark_key:
            per.append((F.lit(self.spec.mark_kind), F.col(self.spec.mark_key).cast("string")))
        each = F.explode(F.array(*[F.struct(k.alias("kind"), v.alias("key")) for k, v in per]))
        return (rows.select(self._day().alias("mark"), each.alias("e")).where("mark IS NOT NULL AND e.key IS NOT NULL")
                .groupBy(F.col("e.kind").alias("kind"), F.col("e.key").alias("key")).agg(F.max("mark").alias("mark")))

    def _marks(self, old: DataFrame, new: DataFrame, batch_id: BatchId | None) -> DataFrame:
        out = old.unionByName(self.marks_of(new))
        if batch_id is not None:
            out = out.unionByName(self.spark.createDataFrame([self._batch_mark(batch_id)], MARKS))
        return out.groupBy("kind", "key").agg(F.max("mark").alias("mark"))

    def _publish(self, kept: list, new: list, marks: DataFrame) -> int:
        version = (self.version() or 0) + 1
        at = f"{self.root}/versions/{version}"
        self.spark.createDataFrame([tuple(f) for f in kept + new], FILES).coalesce(1).write.mode("overwrite").parquet(f"{at}/files")
        marks.write.mode("overwrite").parquet(f"{at}/marks")
        swap_pointer(self.spark, self.root, version)
        return version

    def rebuild_marks(self) -> int:
        """Marks computed anew from the rows (batches kept), published as a version of the same files."""
        kept = self.marks().where("kind IN ('batch', 'writer')")
        return self._publish(self.files().collect(), [], kept.unionByName(self.marks_of(self.read())))

    def vacuum(self, keep: int = 2) -> int:
        """Drop the versions before the last ``keep`` and the data files that only they list; returns how many files went."""
        now = self.version() or 0
        dropped = [v for v in range(1, now - keep + 1) if _hadoop(self.spark, f"{self.root}/versions/{v}")[1].exists(
            _hadoop(self.spark, f"{self.root}/versions/{v}")[0])]
        if not dropped:
            return 0
        held = self.spark.read.schema(FILES).parquet(*[f"{self.root}/versions/{v}/files" for v in range(max(1, now - keep + 1), now + 1)])
        gone = self.spark.read.schema(FILES).parquet(*[f"{self.root}/versions/{v}/files" for v in dropped])
        paths = [r.path for r in gone.select("path").distinct().join(held.select("path"), "path", "left_anti").collect()]
        for p in [*paths, *(f"versions/{v}" for v in dropped)]:
            at, fs = _hadoop(self.spark, f"{self.root}/{p}")
            fs.delete(at, True)
        return len(paths)


def load_market(spark: SparkSession, root: str, frames: dict[str, DataFrame], batch_id: BatchId | None = None) -> dict[str, SnapshotTable]:
    """Load one batch of several logical tables, each by the keys of its spec; full lists (masters,
    calendars) are upserted whole, so entries that a later list lacks stay."""
    out = {}
    for name, df in frames.items():
        out[name] = SnapshotTable(spark, f"{root}/{name}", SPECS[name])
        out[name].upsert(df, batch_id=batch_id)
    return out
