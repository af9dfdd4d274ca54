"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Only a session in one process (master ``local``) may go without: it gets a temporary folder of
    its own. On a cluster every executor would write to its own disk, so a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="docloom-")
    return _local_folders[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts lineage and keeps a result stable across recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard_tables(spark: SparkSession) -> int:
    """Delete the intermediate tables this application wrote; results read from them must be done.

    Returns how many paths were given up.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        _delete(spark, p)
    return len(paths)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one table of ``new_path`` early: nothing reads it any more."""
    _written.get(spark.sparkContext.applicationId, []).remove(path)
    _delete(spark, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is run inside go when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a small input that arrives in fewer splits than there are cores some parallelism.

    Inputs with enough splits (any large table) pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


# Enough for even work on all cores (a table of some size has a split a core or more), each a few ten MB of rows.
SHARES_A_SPLIT = 8


def shares(df: DataFrame) -> int:
    """Into how many shares a costly step over the input ``df`` is dealt: by its splits, which grow with it."""
    return SHARES_A_SPLIT * max(1, df.rdd.getNumPartitions())
