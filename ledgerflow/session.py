"""Spark session defaults and the checkpoint folder rule."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on. Sizes are for the cluster; tests override
# shuffle partitions to the local core count.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE turns a sort-merge join into a broadcast join only when the measured
    # size of a finished shuffle stage is below this bound: that is the size
    # check behind every dimension join, with sort-merge as the fallback.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.files.maxPartitionBytes": "256MB",
    # AQE splits/coalesces shuffle partitions towards this size (and skewed ones above
    # skewedPartitionFactor x median are split): partitions stay far below executor memory.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
    # Delete checkpoint files once their frame is garbage-collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ledgerflow", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    ``master`` is only set when given, so that ``spark-submit`` decides on a cluster.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.host", "127.0.0.1")
        conf.setdefault("spark.driver.bindAddress", "127.0.0.1")
        conf.setdefault("spark.driver.memory", os.environ.get("LEDGERFLOW_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Folders that a task fills side by side. A task of more folders sorts its remaining rows by them, which may spill.
WRITERS = 16


@contextmanager
def _open_writers(spark, number: int):
    """Let the tasks of a write keep ``number`` files open instead of sorting their rows by folder first."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    if not number or int(before or 0):
        yield
        return
    spark.conf.set(key, str(number))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def materialize(df, partition_by: list[str] | None = None, folder: str | None = None, compression: str | None = "zstd"):
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back.

    For a frame that several later jobs consume (the cleaned upload feeds seven
    dimension builds and the fact resolution): without it every consumer re-runs
    the whole lineage (scan, joins, dedup). The stored table survives executor loss,
    readers take only the columns they need, and their filters reach the scan
    (``partition_by`` also prunes folders). Tables of one application share a folder, so
    a retention rule on the checkpoint storage removes them together. ``folder`` names a place of its own instead,
    for tables that stay. ``compression``: zstd takes about 0.7 of the bytes of Spark's own choice (None).
    """
    if is_stored(df) and folder is None:
        return df  # already a stored table: writing it again would only copy it
    spark = df.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer = writer.option("compression", compression) if compression else writer
    with _open_writers(spark, WRITERS if partition_by else 0):
        writer.mode("overwrite").parquet(folder)
    # The written schema is passed on, so that no job has to look for it; partition columns keep their place.
    out = spark.read.schema(df.schema).parquet(folder).select(*df.columns)
    return mark_stored(out)


def mark_stored(df):
    """Say that reading ``df`` costs no more than reading stored files (columns, filters or ids on top of them), so that
    :func:`materialize` does not copy it."""
    try:
        df._lf_materialized = True
    except AttributeError:  # frames that take no attributes are simply written again
        pass
    return df


def is_stored(df) -> bool:
    """Whether ``df`` was marked by :func:`mark_stored`."""
    return getattr(df, "_lf_materialized", False)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where none is set.

    On a cluster the folder must be shared storage named by ``spark.checkpoint.dir``;
    a machine-local folder is accepted only for a local master (tests, benches).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerflow-ckpt-", dir="/tmp"))
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; point it at shared storage (HDFS/S3/ABFS) "
        "before running jobs that cut lineage")
