"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: What each thread stages within its discarded() blocks, innermost last.
_thread = threading.local()


def _scratch() -> list[list[str]]:
    return _thread.__dict__.setdefault("scratch", [])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset and everything runs on one machine (local tests) a temporary folder is
    made; on a cluster each machine would write to its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(shared_dir, "local"):
        shared_dir.local = tempfile.mkdtemp(prefix="spark-lorehive-")
    return shared_dir.local


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lorehive/{name}-{uuid.uuid4().hex}"
    if _scratch():
        _scratch()[-1].append(path)
    return path


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    files, at = _at(spark, path)
    return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []


def rename(spark: SparkSession, path: str, to: str) -> None:
    files, at = _at(spark, path)
    if not files.rename(at, _at(spark, to)[1]):
        raise OSError(f"{path} could not be renamed to {to}")


def remove(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)


@contextlib.contextmanager
def discarded(spark: SparkSession) -> Iterator[None]:
    """Removes what was staged within, at the end: nothing that outlives the block may read it."""
    _scratch().append([])
    try:
        yield
    finally:
        for path in _scratch().pop():
            remove(spark, path)
