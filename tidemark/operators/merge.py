"""Keyed writes: schema alignment, latest-per-key, upsert, insert-if-absent, append.

Plain Parquet has no MERGE, so an upsert is expressed as a set operation
(union with a priority, keep the best row per key) and written back by
rewriting only the partitions the batch touches.

Keys are NULL-safe everywhere: ``groupBy`` puts NULL key parts in one group and
anti-joins use ``<=>``, so re-ingesting a row whose key has a NULL part does
not duplicate it.

"Keep the best row per key" is a ``max(struct(order..., row...))`` aggregate
rather than ``row_number()`` over a window: it is combined map-side before
the shuffle, so a key holding a third of all rows never lands whole in one
task, and the full-row tie-break makes the winner deterministic.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def align_schema(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, list[str]]:
    """Project ``df`` onto ``schema``: cast known columns, NULL-fill missing ones,
    drop (and report) unknown ones, in schema order."""
    have = set(df.columns)
    dropped = [c for c in df.columns if c not in {f.name for f in schema.fields}]
    cols = [(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields]
    return df.select(*cols), dropped


def check_keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Key validation: every key column must exist (raises ValueError otherwise)."""
    keys = list(keys)
    if not keys:
        raise ValueError("at least one key column is required")
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"key column(s) {missing} not in {df.columns}")
    return keys


def _order_cols(order_by: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """One row per key: the row with the greatest ``order_by`` (ties broken by the
    whole row, so the result is deterministic). NULL key parts form one key."""
    keys = check_keys(df, keys)
    if not order_by:
        raise ValueError("order_by is required: it decides which duplicate wins")
    rest = [c for c in df.columns if c not in keys]
    at = {c: f"__o{i}" for i, c in reversed(list(enumerate(order_by))) if isinstance(c, str)}  # a column goes once
    best = F.max(F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(_order_cols(order_by))],
                          *[F.col(c).alias(c) for c in rest if c not in at])).alias("__best")
    out = df.groupBy(*keys).agg(best)
    return out.select(*keys, *[F.col(f"__best.{at.get(c, c)}").alias(c) for c in rest]).select(*df.columns)


def _keys_of(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()


def _on_keys(df: DataFrame, keys: Sequence[str], key_rows: DataFrame, how: str) -> DataFrame:
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(key_rows[f"__k{i}"]) for i, k in enumerate(keys)])
    return df.join(key_rows, on, how)


def _rest(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in keys] or list(keys)


def upsert_merge(base: DataFrame, batch: DataFrame, keys: Sequence[str],
                 order_by: Sequence[str | Column] = (), newest_wins: bool = False) -> DataFrame:
    """Insert new keys, replace every non-key column of existing keys.

    Duplicates of one key inside the batch are resolved by ``order_by`` (the greatest
    wins, ties by the whole row). The batch beats the base; with ``newest_wins`` the
    greater ``order_by`` does, so an older batch never replaces a newer stored row.
    Only the batch is aggregated: base rows of other keys pass an anti-join.
    """
    keys = check_keys(base, keys)
    check_keys(batch, keys)
    order = list(order_by) or _rest(base, keys)
    new = latest_per_key(batch.select(*base.columns), keys, order)
    touched = _keys_of(new, keys)
    if newest_wins:
        new = latest_per_key(_on_keys(base, keys, touched, "left_semi").unionByName(new), keys, order)
    return _on_keys(base, keys, touched, "left_anti").unionByName(new)


def upsert_counts(base: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(inserted, updated) key counts of an upsert, not the batch length."""
    keys = list(keys)
    bk = batch.select(*keys).distinct()
    have = base.select(*keys).distinct().withColumnsRenamed({k: f"__b{i}" for i, k in enumerate(keys)}) \
        .withColumn("__hit", F.lit(True))
    on = reduce(lambda a, c: a & c, [bk[k].eqNullSafe(have[f"__b{i}"]) for i, k in enumerate(keys)])
    flagged = bk.join(have, on, "left")
    return flagged.agg(F.count_if(F.col("__hit").isNull()).alias("inserted"),
                       F.count_if(F.col("__hit").isNotNull()).alias("updated"))


def insert_absent(base: DataFrame, batch: DataFrame, keys: Sequence[str],
                  order_by: Sequence[str | Column] = ()) -> DataFrame:
    """``DO NOTHING`` semantics: add batch rows whose key is not yet present; of batch rows
    with one key the greatest ``order_by`` (ties, or none given: the greatest row)."""
    keys = check_keys(base, keys)
    new = latest_per_key(batch.select(*base.columns), keys, list(order_by) or _rest(base, keys))
    return base.unionByName(_on_keys(new, keys, _keys_of(base, keys), "left_anti"))


#: Marks the rows of the batch in ``merge_laid``.
NEW = "__new"


def merge_laid(rows: DataFrame, within: Sequence[str], keys: Sequence[str], order_by: Sequence[str | Column] = (),
               rule: str = "upsert") -> DataFrame:
    """``upsert_merge`` (``rule`` "upsert", or "newest" for its ``newest_wins``) and ``insert_absent`` ("absent") of
    stored rows and a batch that lie in one table, told apart by the flag ``NEW``.

    The rows are partitioned by columns out of ``within`` (which decide a key's place, such as its slot) and
    ``keys`` already, so a key's rows meet where they lie: nothing is shuffled again, neither for the winner of a
    key nor for the keys that the batch touches.
    """
    columns = [c for c in rows.columns if c not in within and c != NEW]
    order = list(order_by) or _rest(rows.select(*columns), keys)
    named = {c for c in order if isinstance(c, str)}
    greatest = [o.desc() for o in (*_order_cols(order), *[F.col(c) for c in columns if c not in named and c not in keys])]
    flag = F.col(NEW)
    ordered = {"upsert": [flag.desc(), *greatest], "newest": [*greatest, flag.desc()], "absent": [flag, *greatest]}[rule]
    w = Window.partitionBy(*dict.fromkeys([*within, *keys])).orderBy(*ordered)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = rows.select("*", F.row_number().over(w).alias("__n"), F.max(NEW).over(every).alias("__touched"))
    stays = F.col("__n") == 1
    stays = stays | (~flag if rule == "absent" else ~F.col("__touched"))
    return told.where(stays).drop(NEW, "__n", "__touched")


def append_rows(base: DataFrame, batch: DataFrame) -> DataFrame:
    return base.unionByName(batch.select(*base.columns))


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path`` (any file system URI), or None if there is none."""
    import os

    from pyspark.errors import AnalysisException

    local = "/" + path[5:].lstrip("/") if path.startswith("file:") else (None if "://" in path else path)
    if local is not None and not os.path.exists(local):
        return None
    try:
        df = spark.read.parquet(path)
        df.schema  # noqa: B018 - forces the listing
        return df
    except AnalysisException:
        return None


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, fs = _folder(spark, path)
    return fs.exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at, fs = _folder(spark, path)
    fs.delete(at, True)


def _move(spark: SparkSession, source: str, target: str) -> None:
    at, fs = _folder(spark, source)
    if not fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot move {source} to {target}")


def _aside(path: str) -> str:
    """Where the old folder waits while a new one takes its place; readers skip names with an underscore."""
    parent, _, name = path.rpartition("/")
    return f"{parent}/_old.{name}"


def _swap(spark: SparkSession, path: str, staged: str | None) -> None:
    """Put the folder ``staged`` in the place of ``path`` (None: nothing); the old one is deleted last."""
    if _exists(spark, path):
        _move(spark, path, _aside(path))
    if staged is not None:
        _move(spark, staged, path)
    _delete(spark, _aside(path))


def _mend(spark: SparkSession, path: str) -> None:
    """Bring back what a failed swap of the table at ``path`` or of one of its partitions set aside."""
    at, fs = _folder(spark, path)
    inside = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    for folder in [path, *(f"{path}/{n[5:]}" for n in inside if n.startswith("_old."))]:
        if _exists(spark, _aside(folder)):
            if _exists(spark, folder):
                _delete(spark, _aside(folder))
            else:
                _move(spark, _aside(folder), folder)


def upsert_to_path(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str],
                   order_by: Sequence[str | Column], partition_col: str | None = None,
                   newest_wins: bool = False) -> DataFrame:
    """Upsert ``batch`` into the parquet table at ``path``; returns the published table.

    Read and rewritten are the partitions that the batch falls into. Where the partition column is no
    part of the key, those that already hold one of the batch's keys are found by a scan of the stored
    keys, so that a key never stays behind in another partition. The merged rows are written next to the
    table and folders are then moved into place one by one; the old folder is deleted only when the new
    one stands, and the next call brings back what a failure left aside. Readers in between can meet new
    and old partitions; ``sources.snapshots`` publishes all at once.
    """
    path = path.rstrip("/")
    if not batch.isEmpty() or _exists(spark, _aside(path)):
        _mend(spark, path)
    if batch.isEmpty():
        return _read_or_none(spark, path)
    if _read_or_none(spark, path) is None:
        out = latest_per_key(batch, keys, order_by)
        w = out.write.mode("overwrite")
        (w.partitionBy(partition_col) if partition_col else w).parquet(path)
        return spark.read.parquet(path)
    base = spark.read.parquet(path)
    touched = None
    if partition_col:
        falls = batch.select(F.col(partition_col).cast(base.schema[partition_col].dataType))
        if partition_col not in keys:  # else a key is nowhere but in the partition that its batch row falls into
            holding = _on_keys(base.select(*dict.fromkeys([*keys, partition_col])), keys, _keys_of(batch, keys), "left_semi")
            falls = falls.unionByName(holding.select(partition_col))
        touched = [r[0] for r in falls.distinct().collect()]  # partition names
        base = base.where(F.col(partition_col).isin(touched) | (F.lit(None in touched) & F.col(partition_col).isNull()))
    merged = upsert_merge(base, batch.select(*base.columns), keys, order_by, newest_wins)
    stage = f"{path}.new-{uuid.uuid4().hex}"
    if partition_col:
        merged.repartition(partition_col).write.partitionBy(partition_col).parquet(stage)
        at, fs = _folder(spark, stage)
        written = {s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()}
        names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        emptied = {names.getPartitionPathString(partition_col, None if v is None else str(v)) for v in touched} - written
        for name in sorted(written):
            _swap(spark, f"{path}/{name}", f"{stage}/{name}")
        for name in emptied:  # every key of it has moved
            _swap(spark, f"{path}/{name}", None)
    else:
        merged.write.parquet(stage)
        _swap(spark, path, stage)
    _delete(spark, stage)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)
