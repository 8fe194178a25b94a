"""Spark session and shared-storage helpers.

Every plan in this package is a lazy DataFrame; the session only sets the
knobs the plans rely on (UTC time zone, AQE, ANSI) and makes sure a shared
checkpoint directory exists for staged writes.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "tidemark", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_sql_defaults(spark)
    checkpoint_root(spark)
    return spark


#: Partitions that a shuffle writes at least; AQE joins them to tasks of its advisory size, so that the tasks grow
#: in number with the data, not in memory and spill. Up to 200 a map task writes them without holding its rows
#: (spark.shuffle.sort.bypassMergeThreshold). A session that names a number of its own keeps it.
INITIAL_PARTITIONS = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", 200)

#: Shuffled bytes of a task at most where AQE joins partitions. A stage may hold them several times over, as sorts of
#: both sides of a join and as maps of the aggregates after it: about 15 to 30 times the compressed bytes. A session
#: that names a size of its own keeps it.
TASK_BYTES = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32m")


def apply_sql_defaults(spark: SparkSession) -> None:
    """Runtime SQL settings the plans assume (safe to call on any session)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    if spark.conf.get(TASK_BYTES[0], None) is None:
        spark.conf.set(*TASK_BYTES)
    name, number = INITIAL_PARTITIONS
    if spark.conf.get(name, None) is None and int(spark.conf.get("spark.sql.shuffle.partitions")) < number:
        spark.conf.set(name, str(number))


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    On a cluster this is whatever the deployment put in ``spark.checkpoint.dir``
    (a shared file system). Only a local master, where driver and executors are one
    process, falls back to a private temp folder; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
    elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    else:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-ckpt-"))
    return sc.getCheckpointDir()


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return f"{root.rstrip('/')}/staged/{label}-{uuid.uuid4().hex}"


def staged(df, label: str):
    """``df`` written to the shared folder and read back: later steps read files and see one and the same rows."""
    path = staging_path(df.sparkSession, label)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
