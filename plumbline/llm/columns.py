"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """The key and the whole text (null: empty), whatever else ``df`` carries."""
    return df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def text_hash(text: str) -> Column:
    """Hash of the whole text (null: empty): with the key it tells rows apart that share a key or have none."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def crc32_of_id(key: str) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one array of bytes, with the offsets of each text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``most_bytes`` of text, one row at least."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary())
        if len(texts) == 0:
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            end = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
            end = min(len(texts), max(at + 1, end))
            yield batch.slice(at, end - at)
            at = end


def _trim() -> None:
    """Gives freed heap back to the system, where the C library can."""
    if sys.platform == "linux":
        give = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if give is not None:
            give(0)


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow, in a worker that gives back the memory Arrow and the C library hold free: after each batch and at the end of the task.

    A worker serves all later stages of a job; what it keeps of one stage is missing in the next.
    """
    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        try:
            for batch in run(batches):
                yield batch
                pool.release_unused()
        finally:
            pool.release_unused()
            _trim()

    steps.__name__ = run.__name__  # plans show it
    return steps


def vector_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of integers; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()] if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[row]] = flat
    return out
