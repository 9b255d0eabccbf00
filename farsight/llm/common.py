"""Shared pieces: session settings, staging, Arrow batches, sizes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farsight.session import stage_dir, staged

# Texts are large rows: an Arrow batch is closed by bytes or rows, whichever comes first.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Applies the settings to ``spark`` and returns it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` below the shared folder of ``spark.checkpoint.dir`` and reads it back.

    The written table survives lost executors and cuts the lineage.
    """
    return staged(df, stage_dir(df.sparkSession, name))


def plan_bytes(df: DataFrame) -> int:
    """Bytes of the input by the optimizer's statistics; used only to size partition counts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(size, 1 << 50)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(df: DataFrame, key: list[str], rows: int) -> DataFrame:
    """The ``rows`` rows of ``df`` that come first by a hash of the ``key`` columns, ties by those.

    Rows are chosen by their number first, so that about twice as many are compared and moved, from
    however many partitions; a sample for fitting a model, never a way to leave out work.
    """
    n = df.count()
    hashed = df.withColumn("_sample_hash", F.xxhash64(*key))
    if n > 4 * rows:
        hashed = hashed.where(F.shiftrightunsigned("_sample_hash", 11) < int(2 * rows / n * (1 << 53)))
    return hashed.orderBy("_sample_hash", *key).limit(rows).drop("_sample_hash")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def strings_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column; null gives the empty text, bytes that are no UTF-8 the replacement character."""
    try:
        return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
    except UnicodeDecodeError:
        return [t.decode("utf-8", "replace") for t in texts_of(batch, name)]


def chunks(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` bytes; a longer text is alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def give_back() -> None:
    """Returns free memory to the system at the end of a task: workers live on, and what one task took is no use to
    the next step's workers. The C library's own pool is trimmed where it can be."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` per Arrow batch; empty results are left out."""

    def run(batches):
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out
        give_back()

    return df.mapInArrow(run, schema)


def ints(values, kind=pa.int64()) -> pa.Array:
    return pa.array(values, type=kind)


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def sha256_hex(column: Column | str) -> Column:
    return F.sha2(F.col(column) if isinstance(column, str) else column, 256)
