"""A materialised store of the logical tables.

The source application ingests vendor data into stored tables once and
answers every query from them. ``StoredMarketData`` does the same: the first
time a logical table is needed it is derived from the driver tables by its
binding, written as Parquet under the shared checkpoint folder
(``spark.checkpoint.dir``, never a machine-local path on a cluster) and read
back; later queries of the session read the stored table. Writing the table
also cuts the lineage, so a lost executor re-reads files instead of
recomputing the joins that built them.

A table is published by writing its data to a fresh folder and only then a
one-row manifest that names the folder; a failed write leaves no manifest, so
a half-written table is never read.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_root
from tidemark.sources.bindings import MarketData

_LOCK = threading.RLock()
_PUBLISHED: dict[tuple[str, str], str] = {}

# Logical tables that are stored, and the columns their files are clustered by
# (sorted within each file so Parquet statistics can skip row groups on a symbol).
STORED_TABLES = {
    "bars": ("ts_code", "trade_date"),
    "daily": ("ts_code", "trade_date"),
    "adj_factor": ("ts_code", "trade_date"),
    "daily_basic": ("ts_code", "trade_date"),
    "stock_basic": ("ts_code",),
    "hk_basic": ("ts_code",),
    "us_basic": ("ts_code",),
    "trade_cal": ("exchange", "cal_date"),
    "broker_recommend": ("month", "broker"),
    "report_rc": ("ts_code", "report_date"),
    "survey_raw": ("ts_code", "surv_date"),
    "concept_quotes": ("index_code", "trade_date"),
    "concept_members": ("index_code",),
    "concept_meta": ("index_code",),
    "weekly": ("ts_code", "trade_date"),
    "watchlist_input": ("code",),
    "event_days": ("user_id", "day"),
}


def _fingerprint(sf_dir: str) -> str:
    """Identity of the source files: path plus size and mtime of each local file."""
    h = hashlib.sha1(sf_dir.encode())
    local = sf_dir[5:] if sf_dir.startswith("file:") else sf_dir
    if os.path.isdir(local):
        for name in sorted(os.listdir(local)):
            st = os.stat(os.path.join(local, name))
            h.update(f"{name}:{st.st_size}:{int(st.st_mtime)}".encode())
    return h.hexdigest()[:16]


def _local_path(uri: str) -> str | None:
    """Local file-system path of ``uri`` (``file:`` or a bare path), else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


class StoredMarketData(MarketData):
    """``MarketData`` whose derived tables are materialised once per session and source."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str | None = None):
        super().__init__(spark, sf_dir)
        self.root = (root or f"{checkpoint_root(spark).rstrip('/')}/store") + f"/{_fingerprint(self.sf_dir)}"

    def _manifest(self, name: str) -> str:
        return f"{self.root}/_manifest/{name}"

    def _published_path(self, name: str) -> str | None:
        key = (self.root, name)
        if key in _PUBLISHED:
            return _PUBLISHED[key]
        from pyspark.errors import AnalysisException

        manifest = self._manifest(name)
        local = _local_path(manifest)
        if local is not None and not os.path.exists(local):
            return None
        try:
            rows = self.spark.read.json(manifest).collect()  # one row
        except AnalysisException:
            return None
        if not rows:
            return None
        _PUBLISHED[key] = rows[0]["path"]
        return rows[0]["path"]

    def stored(self, name: str, build) -> DataFrame:
        with _LOCK:
            path = self._published_path(name)
            if path is None:
                df = build()
                order = STORED_TABLES.get(name, ())
                path = f"{self.root}/{name}-{uuid.uuid4().hex}"
                (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").option("compression", "zstd").parquet(path)
                self.spark.range(1).select(F.lit(path).alias("path")).coalesce(1) \
                    .write.mode("overwrite").json(self._manifest(name))
                _PUBLISHED[(self.root, name)] = path
        return self.spark.read.parquet(path)


def _wrap(name: str):
    base = getattr(MarketData, name)

    def method(self: StoredMarketData) -> DataFrame:
        return self.stored(name, lambda: base(self))

    method.__name__ = name
    method.__doc__ = base.__doc__
    return method


for _name in STORED_TABLES:
    setattr(StoredMarketData, _name, _wrap(_name))


def build_all(md: StoredMarketData) -> None:
    """Materialise every stored table (the "ingest" step)."""
    for name in STORED_TABLES:
        getattr(md, name)()
