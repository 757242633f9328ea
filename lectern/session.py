"""Make the package importable on the executors of the session at hand."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application (a zip through Spark's own file server)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lectern-"), "lectern.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lectern", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


@functools.cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="lectern-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a local master (driver and executors are one process) has a temporary folder,
    removed at exit; on a cluster this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_dir()


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


@contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files go when what needs them has been written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def kept(rows: DataFrame, path: str, *partitions: str, **options) -> DataFrame:
    """``rows`` as a table at ``path``, read back; the shuffle files behind it are removed."""
    with _tidy(rows.sparkSession):
        rows.write.options(**options).partitionBy(*partitions).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
