"""Session helpers: a local builder for tests and lineage cuts through the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kinfold")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("KINFOLD_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def tables_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where it is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="kinfold-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    base = f"file://{folder}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Folders made by folder() and not deleted so far.
_KEPT: dict[str, None] = {}


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def folder(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder. It is deleted by release(), at the end of its scope(), or else when the application
    ends."""
    path = f"{tables_root(spark)}/kinfold-{kind}-{uuid.uuid4().hex}"
    p, fs = _file_system(spark, path)
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p)
    _KEPT[path] = None
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and return its scan: later reads recompute nothing
    and survive the loss of executors."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinfold_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)
    _KEPT.pop(path, None)


def release(df: DataFrame | None) -> None:
    """Delete a table made by cut() that nothing reads any more."""
    if (path := getattr(df, "_kinfold_path", None)) is not None:
        _delete(df.sparkSession, path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Operators give results that still read tables of cut(). Run and read a query inside a scope, and those tables are
    deleted where it ends:  with scope(spark): cluster(df).write.parquet(target)"""
    before = set(_KEPT)
    try:
        yield
    finally:
        for path in [p for p in _KEPT if p not in before]:
            _delete(spark, path)


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session, as a number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
