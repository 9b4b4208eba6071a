"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillpoint.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table, read through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there, so
    that later stages do not depend on any one executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


ROWS_A_TASK = 100_000  # of a few numbers each


class Packed(NamedTuple):
    rows: DataFrame
    count: int
    tasks: int


def packed(df: DataFrame, rows_a_task: int = ROWS_A_TASK) -> Packed:
    """``cut``, read again in as many tasks as its rows are worth.

    A written table has a part for each task that wrote it, mostly one for each
    partition of a shuffle, however few rows are left.  What one task can hold
    needs no shuffle in later steps either.  Never more tasks than parts."""
    done = cut(df)
    n = done.coalesce(df.sparkSession.sparkContext.defaultParallelism).count()
    tasks = max(1, -(-n // rows_a_task))
    return Packed(done.coalesce(tasks), n, tasks)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that are written and done.

    Spark removes a shuffle's files when the driver's garbage collector finds
    that no plan refers to it any more; a search of many small rounds produces
    little garbage and many files, and would keep them all to its end."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


Batches = Iterator[pa.RecordBatch]


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, giving back at the end of a task what its worker's allocators
    hold: Spark uses a worker again for the tasks of all later stages, and its
    size would stay that of the largest."""

    def wrapped(batches: Batches) -> Batches:
        import ctypes
        import pyarrow
        try:
            yield from run(batches)
        finally:
            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return wrapped
