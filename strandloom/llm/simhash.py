"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming check, components.

Two 64-bit fingerprints that differ in at most d bits agree on at least b - d of b blocks. Every
choice of b - d blocks is a table whose key is the bits of those blocks; close pairs share a key in
at least one table. More blocks mean longer keys and more tables; ``block_plan`` takes the smallest
number whose keys outnumber the distinct fingerprints, so chance meetings stay linear in the input.

Scale: equal fingerprints are one row before anything is paired. Within a key only a spanning forest
of links leaves the task, never all pairs. A key with more than ``group_rows`` fingerprints is
split into chunks, and every pair of chunks is a group of its own, so no task holds more than two
chunks at a time.

Few bits decide only near-equality: texts whose shingles have a Jaccard similarity of 0.8 differ in about
15 % of the bits, 10 of 64, and no plan of blocks for 10 of 64 bits has keys long enough. ``keep_first``
therefore takes wide fingerprints: 12 words of 64 bits, cut into 36 blocks of 21 bits. Texts that share a
block (at 10 % of the bits nearly always, at 15 % two of three times) are linked if at most 39 of the first
256 bits differ (15 %). Keys have the same length at every size, so chance meetings in a key grow with the
rows; they cost a comparison each and are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_parts, mixed, stored, unused, worker_memory
from .components import components, runs


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """64-bit hashes of the word shingles of a text, repeats included (none without words)."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    size = min(size, len(words))
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, n)


def simhash(text: bytes | None, size: int = 4) -> int:
    """64-bit fingerprint of the word shingles of a text (0 without words)."""
    hashes = shingle_hashes(text, size)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


#: Words of a wide fingerprint; those at the front that the Hamming check reads; bits that may differ in
#: these; bits of a block, and blocks of a word.
WIDE, CHECKED, WIDE_DISTANCE, BLOCK_BITS, BLOCKS = 12, 4, 39, 21, 3
_TURNS = np.arange(1, 2 * WIDE, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def wide_simhash(text: bytes | None, size: int = 5) -> np.ndarray:
    """WIDE words of fingerprint, each made from an own bijection of the shingles' hashes (0 without words)."""
    hashes = shingle_hashes(text, size)
    counts = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(hashes), 255):  # so many fit in a byte
        part = mixed(hashes[i : i + 255, None] + _TURNS)
        counts += np.add.reduce(np.unpackbits(part.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def fingerprint_column(size: int):
    @F.arrow_udf("bigint")
    def fingerprint(texts: pa.Array) -> pa.Array:
        worker_memory()
        return in_parts(lambda part: pa.array(np.array([simhash(t, size) for t in as_bytes(part)], np.uint64).view(np.int64), pa.int64()), texts)

    return fingerprint


def wide_column(size: int):
    def prints(part: pa.Array) -> pa.Array:
        found = [wide_simhash(t, size) for t in as_bytes(part)]
        flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * WIDE, pa.int32()), pa.array(flat, pa.int64()))

    @F.arrow_udf("array<bigint>")
    def fingerprint(texts: pa.Array) -> pa.Array:
        worker_memory()
        return in_parts(prints, texts)

    return fingerprint


def block_plan(n: int, distance: int) -> list[tuple[int, ...]]:
    """Bit masks of the tables, in parts: one mask for each choice of blocks."""
    for blocks in range(distance + 2, distance + 8):
        keep = blocks - distance
        if 64 * keep // blocks >= max(n, 1).bit_length() + 1 or blocks == distance + 7:
            break
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [tuple(chosen) for chosen in combinations(masks, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(distance: int, keys: int):
    """Links (a, b) within groups; a spanning forest is enough. Rows come sorted by their ``keys`` first
    columns, the group; then comes the node and the words of its fingerprint (none: the node itself)."""

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bits = np.bitwise_count(x ^ y)
        return (bits[:, 0] if bits.shape[1] == 1 else bits.sum(axis=1, dtype=np.int64)) <= distance

    def within(nodes: np.ndarray, prints: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        left, right = [], []
        sizes = np.diff(starts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        small = np.flatnonzero(sizes[owner] <= 24) if len(sizes) else np.zeros(0, np.int64)
        a, ga = small, owner[small]
        for lag in range(1, 24):
            same = np.flatnonzero(ga[lag:] == ga[:-lag]) if len(ga) > lag else np.zeros(0, np.int64)
            if not len(same):
                break
            x, y = a[same], a[same + lag]
            close = near(prints[x], prints[y])
            left.append(nodes[x[close]])
            right.append(nodes[y[close]])
        for g in np.flatnonzero(sizes > 24):
            rest = starts[g] + np.unique(nodes[starts[g] : starts[g + 1]], return_index=True)[1]
            while len(rest):
                todo, rest = [rest[0]], rest[1:]
                while todo and len(rest):
                    x = todo.pop()
                    close = near(prints[rest], prints[x])
                    if close.any():
                        found, rest = rest[close], rest[~close]
                        left.append(np.full(len(found), nodes[x]))
                        right.append(nodes[found])
                        todo.extend(found)
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            prints = rows[:, keys + 1 :] if rows.shape[1] > keys + 1 else rows[:, keys:]
            left, right = within(rows[:, keys], np.ascontiguousarray(prints).view(np.uint64), runs(rows[:, :keys]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (left, right)], ["a", "b"])

        for batch in batches:
            rows = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(batch.num_columns)], axis=1)
            if not len(rows):
                continue
            held.append(rows)
            last = rows[-1, :keys]
            if (rows[0, :keys] == last).all():
                continue
            all_rows = np.concatenate(held)
            cut = runs(all_rows[:, :keys])[-2]
            yield flush(all_rows[:cut])
            held = [all_rows[cut:]]
        if held:
            yield flush(np.concatenate(held))

    return run


def close_links(prints: DataFrame, distance: int = 4, group_rows: int = 4096) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``distance`` bits of each other.

    ``prints``: one BIGINT column of distinct fingerprints. Not every close pair is a row, but every
    close pair is connected by rows, and every row is a close pair.
    """
    (col,) = prints.columns
    tables = block_plan(prints.count(), distance)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col(col).bitwiseAND(F.lit(_signed(sum(masks)))).alias("k")) for i, masks in enumerate(tables)])
    rows = prints.select(F.col(col).alias("f"), F.explode(keys).alias("x")).select("x.t", "x.k", "f")
    rows = stored(rows, "blocks")
    sizes = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / group_rows).cast("int")
    rows = rows.join(sizes, ["t", "k"]).withColumn("c", chunks).withColumn("i", F.pmod(F.xxhash64("f"), F.col("c")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    rows = rows.select("t", "k", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "f")
    grouped = rows.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return grouped.mapInArrow(_links(distance, 4), "a bigint, b bigint")


def wide_links(prints: DataFrame, group_rows: int = 4096) -> DataFrame:
    """Links (a, b) that connect fingerprints which share a block and differ in at most WIDE_DISTANCE of
    the checked bits. ``prints``: (node BIGINT, words ARRAY<BIGINT> of WIDE words), distinct."""
    mask, count = (1 << BLOCK_BITS) - 1, WIDE * BLOCKS
    place = lambda i: F.shiftrightunsigned(F.col("words")[i // BLOCKS], BLOCK_BITS * (i % BLOCKS)).bitwiseAND(F.lit(mask)) + F.lit(i << BLOCK_BITS)
    check = [F.col("words")[i].alias(f"c{i}") for i in range(CHECKED)]
    rows = prints.select("node", *check, F.explode(F.array(*[place(i) for i in range(count)])).alias("k"))
    # Only keys that are split are joined; the others go where their rows are dealt.
    large = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows)
    rows = rows.join(large, "k", "left").withColumn("c", F.coalesce(F.ceil(F.col("n") / group_rows), F.lit(1)).cast("int"))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("node"), F.col("c")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    rows = rows.select("k", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node", *[f"c{i}" for i in range(CHECKED)])
    return rows.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(_links(WIDE_DISTANCE, 3), "a bigint, b bigint")


def _rooted(prints: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """prints with root and component_id; ``distinct``: (print, least) for every fingerprint."""
    roots = components(links)
    named = distinct.join(roots.withColumnRenamed("v", "print"), "print", "left").select("print", "least", F.coalesce("m", "print").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("print", "root", "component_id")
    return prints.join(named, "print")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int, group_rows: int) -> DataFrame:
    """(id, mark, print, root, component_id) for each row; mark is a hash of the text."""
    text = F.col(text_col).cast("binary")
    prints = stored(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), fingerprint_column(shingle)(text).alias("print")), "prints")
    distinct = stored(prints.groupBy("print").agg(F.min("id").alias("least")), "distinct-prints")
    return _rooted(prints, distinct, close_links(distinct.select("print"), distance, group_rows))


def _grouped_wide(docs: DataFrame, id_col: str, text_col: str, shingle: int, group_rows: int) -> DataFrame:
    """As ``_grouped``, where print is a 64-bit hash of the wide fingerprint."""
    text = F.col(text_col).cast("binary")
    wide = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), wide_column(shingle)(text).alias("words"))
    prints = stored(wide.select("id", "mark", F.xxhash64("words").alias("print"), "words"), "prints")
    distinct = stored(prints.groupBy("print").agg(F.min("id").alias("least"), F.first("words").alias("words")), "distinct-prints")
    links = wide_links(distinct.select(F.col("print").alias("node"), "words"), group_rows)
    return _rooted(prints.drop("words"), distinct.drop("words"), links)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 4, distance: int = 4, group_rows: int = 4096) -> DataFrame:
    """One row (``id_col``, ``print`` BIGINT, ``component_id``) for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links of fingerprints that differ in at most
    ``distance`` bits. Null texts and texts without words have fingerprint 0 and link like any other;
    equal fingerprints are linked. Null ids never name a component unless all its ids are null.
    Repeated rows give repeated results; an empty table gives none.
    """
    found = _grouped(docs, id_col, text_col, shingle, distance, group_rows)
    return found.select(F.col("id").alias(id_col), "print", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, wide: bool = True, distance: int = 4, group_rows: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay: exactly one of each near group, that with the smallest id.

    Null ids come last; rows of one id are told apart by a hash of their text, and of equal rows one
    stays. With ``wide`` a group is made of links that hold for word shingles at a similarity of about 0.8
    and more (see the module's notes); without, of fingerprints within ``distance`` bits. Null texts and texts without words are one group; texts are read whole; columns stay as they
    are, whatever their names; an empty table gives an empty result.
    """
    found = _grouped_wide(docs, id_col, text_col, shingle, group_rows) if wide else _grouped(docs, id_col, text_col, shingle, distance, group_rows)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first"), F.count(F.lit(1)).alias("n"))
    own, mark = unused(docs, "__id", "__mark")
    first = first.select(F.col("first.id").alias(own), F.col("first.mark").alias(mark))
    text = F.col(text_col).cast("binary")
    stay = docs.join(first, docs[id_col].eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(mark)))
    repeated = found.groupBy("id", "mark").count().where("count > 1")
    if not repeated.isEmpty():
        stay = stay.dropDuplicates([own, mark])
    return stay.select(*[docs[c] for c in docs.columns])
