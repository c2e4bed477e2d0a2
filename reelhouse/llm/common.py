"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelhouse.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage: a lost executor's share is read again, not computed anew.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, giving freed memory back to the system when a task ends.

    Spark keeps idle Python workers for the next task; without this each holds
    on to the most it ever needed.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = _libc()
            if libc is not None and hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``labels`` table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``pages`` table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``conversations`` table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")


def text_of(column: str) -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
