"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, and where that is unset a new folder if there is but one machine; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or _own_dir()).rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt to all cores if its files make fewer tasks than there are cores, as one large row group does; other tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """`df` for every task of a join, once it was counted; more than `most` rows are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return F.broadcast(df)


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write `df` to a new table in the shared folder and read it back: later steps start from the files, also after executors are lost.

    The frame that comes back is lazy, so the table stays: until the end of the
    `scratch` block that it was cut in, else until `clear`; with `keep` until the
    folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not keep:
        _open_scopes()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that a thread has cut, by `scratch` block; the first are those outside of any.
_scopes = threading.local()


def _open_scopes() -> list[list[str]]:
    if not hasattr(_scopes, "open"):
        _scopes.open = [[]]
    return _scopes.open


def delete_paths(spark: SparkSession, paths: list[str]) -> int:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut within the block, by its thread, are deleted at its end; what is needed of them must be written by then."""
    _open_scopes().append([])
    try:
        yield
    finally:
        delete_paths(spark, _open_scopes().pop())


def clear(spark: SparkSession) -> int:
    """Delete the tables that this thread has cut outside of `scratch` blocks, but for those to keep, once no frame that reads them is needed any more; their number."""
    outer = _open_scopes()[0]
    paths, outer[:] = [*outer], []
    return delete_paths(spark, paths)
