"""What the text operators share: batch maps over Arrow in slices of bounded size."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.plans.cuts import Cuts

__all__ = ["Cuts", "chunks", "forget", "held_out", "keep", "learnable", "map_batches", "map_chunks", "release", "row_hash", "small_batches", "text_bytes"]

#: Bytes of text that a Python function gets at once.
CHUNK_BYTES = 2 << 20
#: Rows of a batch that the JVM hands to Python; a whole one is in memory several times, on both sides.
BATCH_ROWS = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of a batch to ``BATCH_ROWS`` if they are more, as rows with texts may be long."""
    rows = int(spark.conf.get(_ROWS, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of ``column`` each; a single longer row makes a slice of its own."""
    start, total = 0, 0
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def release() -> None:
    """Hands free memory back to the system: workers wait for their next task, or the next stage's, with what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


#: What this process keeps from one task to the next: the operator that it is for, what it was made from, and the thing itself.
_kept: list[tuple[str, tuple, Any]] = []


def keep(owner: str, key: tuple, make: Callable[[], Any]) -> Any:
    """``make()``, made once for tasks of the same operator and key that follow each other in a process."""
    if not _kept or _kept[0][:2] != (owner, key):
        forget()
        _kept.append((owner, key, make()))
    return _kept[0][2]


def forget(but: str | None = None) -> None:
    """Drops what is kept for another operator: workers go from one operator to the next, and would hold the memos of all."""
    if _kept and _kept[0][0] != but:
        _kept.clear()
        gc.collect()  # memos refer to what they are memos of
        release()


def map_batches(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, owner: str | None = None) -> DataFrame:
    """``mapInArrow`` in small batches; a worker hands its memory back when a task ends, but for what is kept for the ``owner``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(owner)
        try:
            yield from fn(batches)
        finally:
            release()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_chunks(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema, column: str = "text", limit: int = CHUNK_BYTES, owner: str | None = None) -> DataFrame:
    """``fn`` over slices of bounded size; nothing stays from one slice to the next but what ``fn`` has kept for the ``owner``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, column, limit):
                yield fn(part)

    return map_batches(df, run, schema, owner)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def row_hash(df: DataFrame) -> Column:
    """Of all columns that can be hashed; with its id it stands for a row, and repeated rows have the same."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))))


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """True for a quarter of the ids; a null id has no remainder and is false."""
    return F.coalesce(_remainder(doc_id) == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """True for the ids that models learn from: those that aren't held out, null ids not among them."""
    return F.coalesce(_remainder(doc_id) != 2, F.lit(False))
