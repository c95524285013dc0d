"""What the operators share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from gridweave.storage import shared_dir, stored, work_path  # noqa: F401  the operators take them from here

#: Bytes of text that one Python step holds at a time; a longer text comes alone.
CHUNK_BYTES = 4 << 20


#: What a Python step is handed at a time, whatever the length of the rows.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the session's Arrow batches are bounded in bytes from here on, as texts may be long."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> None:
    spark.conf.set(ARROW_BYTES, str(CHUNK_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with strokes before it where df has a column of that name, in capitals or not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def filesystem(uri: str):
    """pyarrow's file system for a folder of the shared storage, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of ``column``, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def release() -> None:
    """Gives a worker's free memory back: it stays alive for later stages, beside the JVM of its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
