"""Folders that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a temporary one, and only if all of Spark runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loglattice-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_arrow_batches(spark: SparkSession, limit: str = "8m") -> Iterator[None]:
    """Bounds the batches that tasks pass to Python, for rows of some kilobytes each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, limit)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, which cuts its lineage.

    ``compression`` is the session's if none is given.

    The files survive lost executors; they stay until :func:`forget` removes
    them or the folder is cleaned.
    """
    path = fresh(df.sparkSession, name)
    with small_arrow_batches(df.sparkSession):
        df.write.parquet(path, compression=compression)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.settled_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Removes the files of settled tables that nothing reads any more."""
    for table in tables:
        drop(table.sparkSession, table.settled_at)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a path below the shared folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def workers(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
