"""Line dedup with two Bloom filters: hashes seen once and hashes seen twice.

Pass 1 fills both filters with the key hashes of every line (each document counts once).
Filters of different tasks are merged slot by slot: a slot is "twice" if it is in either side,
or "once" in both. Pass 2 lets only keys whose slots are all "twice" through to a shuffle, where
they are counted exactly by a 128-bit hash, and the surviving document of each key is chosen.

Scale: the filters have a fixed number of slots (``filter_bits``), so what is collected and
broadcast never grows with the data. A fuller filter lets more once-seen keys through to the exact
count; the result stays exact. Counts are combined on the map side, and a key that a third of all
documents hold is one row per task there; the join that brings verdicts back is salted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_bytes, stored, unused, worker_memory

SLICES = 64
ROWS = 500  # rows of a batch that are held as Python objects at a time


def line_keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """Key of each line of a text, None where it is too short to count."""
    keys: list[bytes | None] = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(SPACE)
        if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
            keys.append(None)
        else:
            keys.append(key.lower())
    return keys


def _digests(text: bytes | None, min_chars: int) -> set[bytes]:
    return {xxhash.xxh3_128_digest(k) for k in line_keys(text, min_chars) if k is not None}


def _slots(digests: np.ndarray, bits: int) -> np.ndarray:
    """Two slots for each 128-bit digest, as an array of shape (n, 2)."""
    return (digests >> np.uint64(64 - bits)).astype(np.int64)


def _has(cells: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((cells[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def _set(cells: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(cells, at >> 3, np.left_shift(np.uint8(1), (7 - (at & 7)).astype(np.uint8)))


def _seen_slices(min_chars: int, bits: int):
    part = (1 << bits) // SLICES // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        once, twice = np.zeros((1 << bits) // 8, np.uint8), np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                found = [d for text in as_bytes(batch.column(0).slice(lo, ROWS)) for d in _digests(text, min_chars)]
                if not found:
                    continue
                # Keys of several of these documents have been seen twice, others if they were before.
                keys, n = np.unique(np.frombuffer(b"".join(found), ">u8").astype(np.uint64).reshape(-1, 2), axis=0, return_counts=True)
                at = _slots(keys, bits)
                _set(twice, at[(n > 1) | _has(once, at)])
                _set(once, at)
        rows = [
            (i, kind, zlib.compress(a[i * part : (i + 1) * part].tobytes(), 1))
            for i in range(SLICES)
            for kind, a in ((1, once), (2, twice))
            if a[i * part : (i + 1) * part].any()
        ]
        if rows:
            ids, kinds, cells = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(kinds, pa.int32()), pa.array(cells, pa.binary())], ["slice", "kind", "bits"])

    return run


def _merged_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the slices of all tasks; the memory is that of the slices, not of the tasks."""
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, kind, cell in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            a = np.frombuffer(zlib.decompress(cell), np.uint8)
            if kind == 2:
                twice[i] = twice[i] | a if i in twice else a
            elif i in once:
                both = once[i] & a
                twice[i] = twice[i] | both if i in twice else both
                once[i] = once[i] | a
            else:
                once[i] = a
    if twice:
        yield pa.RecordBatch.from_arrays([pa.array(list(twice), pa.int32()), pa.array([a.tobytes() for a in twice.values()], pa.binary())], ["slice", "bits"])


def _suspects(min_chars: int, bits: int, filter_cells):
    part = (1 << bits) // SLICES // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        twice = np.zeros((1 << bits) // 8, np.uint8)
        for i, cell in filter_cells.value.items():
            twice[i * part : (i + 1) * part] = np.frombuffer(cell, np.uint8)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                ids, keys = [], []
                for doc, text in zip(batch.column(0).slice(lo, ROWS).to_pylist(), as_bytes(batch.column(1).slice(lo, ROWS)), strict=True):
                    found = _digests(text, min_chars)
                    ids += [doc] * len(found)
                    keys += found
                if keys:
                    hit = _has(twice, _slots(np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2), bits)).tolist()
                    ids, keys = ([x for x, h in zip(c, hit, strict=True) if h] for c in (ids, keys))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(keys, pa.binary())], ["id", "key"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 40, min_docs: int = 5, filter_bits: int = 26) -> DataFrame:
    """Drop lines that many documents share, but in the largest id that holds them.

    Returns all columns of ``docs`` and ``n_lines``, ``n_dropped``, ``kept_text`` (these three take
    the place of columns so named). A text is split at line feeds; null and empty texts are one empty
    line. A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at
    least ``min_chars`` code points in at least ``min_docs`` documents lose all lines except in the
    largest ``id_col`` that holds them.

    Edge cases: every row is a document, so repeated rows count as documents and share their fate;
    a null id is below all others and keeps lines only if all holders are null; a tie for the largest id
    keeps the lines of all rows of that id; texts are split whole, however long; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    salts = min(64, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    lost_id, lost_keys, made = unused(docs, "__lost_id", "__lost", "__cut")
    text = F.col(text_col).cast("binary").alias("text")
    slices = docs.select(text).mapInArrow(_seen_slices(min_chars, filter_bits), "slice int, kind int, bits binary")
    merged = slices.repartition("slice").mapInArrow(_merged_slices, "slice int, bits binary")
    # At most 2 ** filter_bits / 8 bytes, whatever the input.
    cells = spark.sparkContext.broadcast({r[0]: bytes(r[1]) for r in merged.collect()})
    ids = docs.select(F.col(id_col).alias("id"), text)
    kind = docs.schema[id_col].dataType.simpleString()
    suspects = stored(ids.mapInArrow(_suspects(min_chars, filter_bits, cells), f"id {kind}, key binary"), "line-suspects")
    known = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("winner")).where(F.col("n") >= min_docs).select("key", "winner")
    # A key that very many documents hold is dealt over 8 to 64 tasks; the few verdicts are
    # repeated for it.
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    lost = suspects.withColumn("salt", salt).join(known, ["key", "salt"]).where(~F.col("id").eqNullSafe(F.col("winner")))
    lost = lost.groupBy(F.col("id").alias(lost_id)).agg(F.collect_set("key").alias(lost_keys))

    @F.arrow_udf("struct<n_lines:bigint,n_dropped:bigint,kept_text:string>")
    def cut(texts: pa.Array, lost: pa.Array) -> pa.Array:
        worker_memory()
        n_lines, n_dropped, kept = [], [], []
        for text, gone in ((t, g) for lo in range(0, len(texts), ROWS) for t, g in zip(as_bytes(texts.slice(lo, ROWS)), lost.slice(lo, ROWS).to_pylist(), strict=True)):
            lines = (text or b"").split(b"\n")
            n_lines.append(len(lines))
            if gone:
                gone = set(gone)
                left = [line for line, key in zip(lines, line_keys(text, min_chars), strict=True) if key is None or xxhash.xxh3_128_digest(key) not in gone]
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left))
            else:
                n_dropped.append(0)
                kept.append(text or b"")
        return pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_lines", "n_dropped", "kept_text"])

    joined = docs.join(lost, docs[id_col].eqNullSafe(F.col(lost_id)), "left")
    out = joined.withColumn(made, cut.asNondeterministic()(docs[text_col].cast("binary"), F.col(lost_keys)))
    names = ("n_lines", "n_dropped", "kept_text")
    return out.select(*[docs[c] for c in docs.columns if c.lower() not in names], *[F.col(f"{made}.{c}").alias(c) for c in names])
