"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_made_up: dict[str, str] = {}  # scratch folders of local applications that name none


def local_session(cores: str = "*", shuffle_partitions: int = 8, scratch: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    return (
        builder.master(f"local[{cores}]")
        .appName("lexigraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LEXIGRAPH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. A machine-local folder is
    only made up for local sessions, where driver and tasks share the disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _made_up:
        _made_up[application] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _made_up[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


_open_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession):
    """Tables that ``materialize`` writes inside are deleted at the end, but for those that are told to stay.

    For steps whose own result is written before the end; what is read lazily later must stay.
    """
    _open_scopes.append([])
    try:
        yield
    finally:
        for path in _open_scopes.pop():
            remove(spark, path)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a table that is written inside go once it is there, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, stays: bool = False) -> DataFrame:
    """Write a table that several later steps read, and return it as read back.

    Inside ``temporary`` it goes with the scope, unless it ``stays`` for the scope around that one.
    """
    path = scratch_path(df.sparkSession, name)
    scopes = _open_scopes[:-1] if stays else _open_scopes
    if scopes:
        scopes[-1].append(path)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_dropped(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _file_system(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    where, files = _file_system(spark, path)
    files.delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """Bring a table with fewer splits than cores up to the cluster's parallelism.

    Text work is bound by the processor, so a small file in one split would keep
    one core busy. A table with enough splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < 2 * cores else df
