"""Session defaults, tables between jobs, lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tremor", master: str | None = None,
                  shuffle_partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """UTC, AQE on (coalescing, skew splitting, size-checked broadcasts).
    ``shared`` is the folder that all machines see (``spark.checkpoint.dir``)."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if shared:
        b = b.config("spark.checkpoint.dir", shared)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, else the one set
    on the context.  A temporary folder serves local masters only; elsewhere
    each machine would have its own, so the lack of a folder is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("TREMOR_SHARED_DIR") or sc.getCheckpointDir()
    if path:
        return path
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = getattr(spark, "_tremor_shared_dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark._tremor_shared_dir = path
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_WRITTEN: "weakref.WeakKeyDictionary[SparkSession, list[str]]" = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: what follows is
    planned on its real size, scans only the columns it needs, and survives
    the loss of executors.  ``release`` deletes what a session has written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tremor_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` has returned and nothing reads any
    more; other DataFrames are left alone."""
    for table in tables:
        path, paths = getattr(table, "_tremor_path", None), _WRITTEN.get(table.sparkSession, [])
        if path in paths:
            paths.remove(path)
            _delete(table.sparkSession, path)


#: Spark's own switch: an action's shuffle files go when it ends
_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, each action's shuffle files are deleted as it ends.  Else they
    lie on the executors' disks until the driver happens to collect garbage."""
    before = spark.conf.get(_SHUFFLES_END, None)
    spark.conf.set(_SHUFFLES_END, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLES_END) if before is None else spark.conf.set(_SHUFFLES_END, before)


def release(spark: SparkSession) -> int:
    """Deletes the tables between jobs that this session has written; results
    that still read them must have been stored before.  Returns their number."""
    paths = _WRITTEN.pop(spark, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
