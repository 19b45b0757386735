"""Helpers that the operators share: tables, materialised steps and text batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import iterate
from ..operators.iterate import drop  # noqa: F401

#: Bytes of text that a kernel takes at a time; longer texts are taken whole.
CHUNK_BYTES = 1 << 20
#: Bytes of a batch that goes to a worker, where the session doesn't set them: the JVM and the worker each hold one of them.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES for workers, unless the session has a smaller size; rows of any length then need no more."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # as it comes
        spark.conf.set(name, str(BATCH_BYTES))


def materialize(df: DataFrame, what: str = "step") -> DataFrame:
    """df as a step in the shared folder (see operators.iterate); its workers get small batches."""
    small_batches(df.sparkSession)
    return iterate.materialize(df, what)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes for a task of a shuffle by buckets.
TASK_BYTES = 64 << 20


def tasks(spark: SparkSession, size: int) -> int:
    """Partitions of a shuffle of about size bytes: the session's number, or as many as keep a task at TASK_BYTES."""
    return max(shuffle_partitions(spark), -(-size // TASK_BYTES))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of UTF-8 in all rows."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, nulls as empty, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


#: What kernels of a worker remember from task to task, by their names.
_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What the owner remembers; a worker that turns to another kernel forgets the rest."""
    for other in [k for k in _KEPT if k != owner]:
        del _KEPT[other]
    return _KEPT.setdefault(owner, {})


def apart(docs: DataFrame, *own: str | None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all but its own columns under names that no helper column has, and what gives them their names back."""
    other = {c: f"other {i}" for i, c in enumerate(docs.columns) if c not in own}
    return docs.withColumnsRenamed(other), lambda df: df.select(*[F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns])


def release() -> None:
    """Give memory that nothing holds back to the system: workers outlive their tasks, and an executor has many."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def split(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts that hold about limit bytes of the column each; a longer text stands alone."""
    _, offs = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, owner: str = "") -> Iterator[pa.RecordBatch]:
    """The batches, split so that each holds about limit bytes of the column; what a worker no longer needs is released."""
    kept(owner)
    release()
    for batch in batches:
        yield from split(batch, column, limit)
    release()


def take_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def byte_strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary value for each range of data."""
    offs = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(data[take_ranges(starts, lengths)])])


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
