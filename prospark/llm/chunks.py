"""Documents dealt into bounded chunks, and blocks of sorted numbers that travel between chunks and key ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes of one chunk; a task holds one chunk at a time.
CHUNK_BYTES = 8 << 20


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, counted over the whole column."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def partitions_for(docs: DataFrame, total_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Partitions that hold about `chunk_bytes` of text each, and no fewer than the session's own number."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // chunk_bytes))


def spread(values: np.ndarray, ranges: int) -> np.ndarray:
    """The key range, 0 to ranges - 1, of uniformly spread 64-bit names."""
    return ((values >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def planes(values: np.ndarray) -> bytes:
    """Bytes of fixed-width numbers, first all lowest bytes, then the next: even planes pack well in a shuffle."""
    v = np.ascontiguousarray(values)
    return np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T).tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of each run of equal neighbours."""
    if not len(values):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return first, np.diff(np.append(first, len(values)))


def field(table: pa.Table, struct: str, name: str) -> pa.Array:
    """One field of a struct column as a single array; a null struct gives nulls."""
    column = table.column(struct).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    return column.field(name) if not column.null_count else pa.compute.struct_field(column, name)


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns of `docs` as one struct `doc`, so that no name of theirs can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *more)
