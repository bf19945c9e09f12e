"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can reach.

    Where that setting is empty, a session in one process takes a temporary folder, as in tests; a cluster's fails.
    """
    base, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not base:
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stratadoc-")
    return f"{base.rstrip('/')}/stratadoc-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and lost executors cost no earlier work."""
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], text_column: int = 1, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the given string column holds about `most` bytes in each (one row at least)."""
    for batch in batches:
        start, size = 0, 0
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_column)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def single_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row, where rows are large: one at a time is in Python's memory."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def give_back() -> None:
    """Return this process's free memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(function: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A generator of a task that gives its memory back at the end, as Python workers stay between tasks."""

    @functools.wraps(function)
    def run(*args):
        try:
            yield from function(*args)
        finally:
            give_back()

    return run


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner drop the shuffle files of steps whose results are written; it waits for a collection of garbage.

    It saves disk only: nothing depends on whether or when the files go.
    """
    for _ in range(2):  # what the first collection frees may hold more
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)
