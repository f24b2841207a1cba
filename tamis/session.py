"""Session settings and the shared scratch folder every multi-pass job writes to."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
ARROW_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_local_root: list[str] = []  # of this process, where the session names none
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()  # where a frame was written to
_paths: dict[str, None] = {}  # of all tables this process has written and not removed, in order


def build_session(app: str = "tamis", cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session, or a temporary one in local mode only."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="tamis-"))
    return _local_root[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/tamis/{label}-{uuid.uuid4().hex}"


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs begun in here hand rows to Python in batches of about ``size`` bytes; the session's setting is put back afterwards.

    A batch may otherwise be 64 MB, which both the JVM and the Python worker of a task hold.
    """
    had = spark.conf.get(ARROW_KEY)
    spark.conf.set(ARROW_KEY, str(size))
    try:
        yield
    finally:
        spark.conf.set(ARROW_KEY, had)


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The written table outlives any executor, cuts the lineage, and gives the
    optimizer a real size for the joins that follow.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _tables[table] = path
    _paths[path] = None
    return table


def written() -> set[str]:
    """Paths of the tables this process has written and not removed."""
    return set(_paths)


def discard_unread(paths: set[str], still_read: DataFrame) -> None:
    """Remove written tables by their paths, without those a frame reads."""
    read = still_read.inputFiles()
    for path in paths:
        if path in _paths and not any(path.rpartition("/")[2] in file for file in read):
            remove(still_read.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _paths.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` returned, once nothing reads them any more.

    Only a table written by this process goes, by its own path; other frames are left alone.
    """
    for table in tables:
        path = _tables.pop(table, None)
        if path is not None:
            remove(table.sparkSession, path)
