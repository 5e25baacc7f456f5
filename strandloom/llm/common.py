"""Pieces that the corpus operators share: tables, stored intermediates, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import forget
from ..operators.ranking import kept as stored

__all__ = ["SPACE", "WORD", "as_bytes", "forget", "in_parts", "mixed", "sliced", "stored", "table", "unused", "word_count", "word_hashes", "worker_memory"]

#: The six ASCII white-space characters that separate words.
SPACE = b" \t\n\x0b\x0c\r"
#: The same set, as a Java or Python pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a Python worker keeps from task to task: one value, of the operator that ran last.
_KEPT: dict[str, object] = {}


def worker_memory(key: str | None = None, make=None):
    """The value kept under ``key``, made if there is none; whatever another operator has kept goes.
    Called without a key at the start of a task, it frees the worker's memory for that task."""
    if key is None or key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        if key is not None:
            _KEPT[key] = make()
    return _KEPT.get(key) if key is not None else None


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, made from ``names`` by underscores."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows. Spark bounds a batch in bytes (64 MB unless configured); what an
    operator makes of a batch as Python objects is bounded by this."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def in_parts(f: Callable[..., pa.Array], *columns: pa.Array, rows: int = 2_000) -> pa.Array:
    """f over stretches of at most ``rows`` rows of the columns, put together again."""
    parts = [f(*(c.slice(lo, rows) for c in columns)) for lo in range(0, max(1, len(columns[0])), rows)]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def word_count(text: Column) -> Column:
    """Words of a text as a BIGINT, zero for null; JVM only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Cells of a string or binary column as UTF-8 bytes, None for null."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return column.to_pylist()


_RANDOM = np.random.Generator(np.random.PCG64(20_240_601))
#: A random number for each byte, and odd factors for the place of a byte in its word.
_BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_PLACE = _RANDOM.integers(0, 1 << 64, 4096, np.uint64) | np.uint64(1)
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACE, np.uint8))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts one after the other, and the words of each text.

    Words are maximal runs without ASCII white space; equal words have equal hashes in every task.
    """
    data = b"\n".join([t or b"" for t in texts]) + b"\n"
    code = np.frombuffer(data, np.uint8)
    space = _IS_SPACE[code]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.append(0, edge)
    starts, ends = edge[::2], edge[1::2]
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    cuts = np.searchsorted(starts, np.append(0, np.cumsum(sizes)))
    if not len(starts):
        return np.zeros(0, np.uint64), np.diff(cuts)
    length = ends - starts
    inside = ~space
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    term = _BYTE[code[inside]] * _PLACE[place & 4095]
    if int(length.max()) > 4096:
        term *= (2 * (place >> 12) + 1).astype(np.uint64)
    sums = np.add.reduceat(term, np.cumsum(length) - length)
    return mixed(sums + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.diff(cuts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher (two multiply and shift steps)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
