"""Helpers shared by the training-data operators: batching, hashing, folds; storage and components come from the core."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..operators.graph import components
from ..storage import drop_path, drop_table, materialize, shared_dir, table, work_path


def text_slices(batch: pa.RecordBatch, column: int, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice holds much more than max_bytes of the column; a longer row stays alone."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + max_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def return_memory() -> None:
    """Give what this process has freed back to the system; the allocators of Arrow and C keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        trim(0)


def held_out(doc_id: str = "doc_id"):
    """Fold column of the operators that learn: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


__all__ = ["as_bytes", "components", "drop_path", "drop_table", "held_out", "materialize", "mix64", "return_memory", "shared_dir", "table", "text_slices", "work_path"]
