"""Substring dedup by recompression (see ``recompression``).

1. Anchors of all windows are counted by name; a window whose anchor occurs once cannot repeat. The
   names that occur more than once fill a filter of a fixed number of bits.
2. Symbols of at least ``window`` words are shared or not by a check of 96 bits of their content: all
   words of a shared symbol are removed, so copies of whole documents ask for no windows.
3. Windows that cover a word still open and whose anchor passes the filter ask whether they repeat.
   A second filter holds a rolling hash of what is asked; windows of the corpus that pass it bear
   witness, and asks and witnesses meet in a check by 96 bits of two hashes of their words. Words are
   hashed to 64 bits first, so equal windows always meet and unequal ones with a chance of about
   2 ** -64 for each pair of unequal words in the same place.

Scale: the rounds need no exchange, as names are functions of content. Anchors shuffle as one number,
long symbols as one row for 60 words, and windows only near the ends of repeats. What a batch sees
twice is settled there, its spans are dealt by their places, and its content leaves one witness, for
windows two in a task as a rule; so a passage that a third of all documents hold is no hot key. Texts
are compressed before they are dealt by document. The filters are the only thing collected and broadcast
(2 ** filter_bits bits whatever the input); a fuller one lets more windows through to the last check and
changes no result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import as_bytes, in_parts, mixed, sliced, stored, word_hashes, worker_memory
from .recompression import parse, window_starts

SLICES = 1024
PLACES = (0, 21, 42)
PART = 400  # most documents parsed together
PART_BYTES = 250_000  # about as many bytes of text, so that arrays stay in a core's cache
#: An odd factor and its inverse modulo 2 ** 64.
_STEP = np.uint64(0x9FB21C651E98DF25)
_BACK = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))
#: The same for the second hash, and what is mixed into its words.
_OTHER_STEP = np.uint64(0xD1B54A32D192ED03)
_OTHER_BACK = np.uint64(pow(0xD1B54A32D192ED03, -1, 1 << 64))
_OTHER = np.uint64(0x8CB92BA72F3D8DD7)
ROWS = "h1 bigint, h2 int, n int, k1 bigint, k2 bigint, lo int, hi int"
NAMES = [c.split()[0] for c in ROWS.split(", ")]


def _parts(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, word hashes one after the other, words of each) of about PART documents."""
    worker_memory()
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and j < i + PART and (j == i or size < PART_BYTES):
            size += len(texts[j] or b"")
            j += 1
        yield i, *word_hashes(texts[i:j])
        i = j


def _short(names: np.ndarray) -> np.ndarray:
    """48 bits of a name: a filter needs no more, and less is sent."""
    return names >> np.uint64(16)


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [np.zeros(0, np.uint64)]
            for _, words, sizes in _parts(as_bytes(batch.column(0))):
                p = parse(words, sizes, window, window_starts(sizes, window), nodes=False)
                found.append(_short(p.anchor[p.fresh]))
            names, n = np.unique(np.concatenate(found), return_counts=True)
            # Twice where the batch has it more than once: no count needs to be sent.
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([names, names[n > 1]]).view(np.int64))], ["name"])

    return run


def _places(names: np.ndarray, bits: int) -> np.ndarray:
    """Three places of each name within its slice of the filter."""
    size = np.uint64((1 << bits) // SLICES)
    x = mixed(names)
    return np.stack([(x >> np.uint64(s)) % size for s in PLACES], axis=1).astype(np.int64)


def _filter_slices(bits: int):
    size = (1 << bits) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((SLICES, size), np.bool_)
        for batch in batches:
            names = np.asarray(batch.column(0)).view(np.uint64)
            cells[(names % np.uint64(SLICES)).astype(np.int64)[:, None], _places(names, bits)] = True
        some = np.flatnonzero(cells.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([zlib.compress(np.packbits(cells[i]).tobytes(), 1) for i in some], pa.binary())], ["slice", "bits"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            bits = np.frombuffer(zlib.decompress(cell), np.uint8)
            held[i] = held[i] | bits if i in held else bits
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([a.tobytes() for a in held.values()], pa.binary())], ["slice", "bits"])


def _filter(names: DataFrame, bits: int):
    """Broadcast bits of a Bloom filter of the one BIGINT column."""
    cells = names.mapInArrow(_filter_slices(bits), "slice int, bits binary").repartition("slice").mapInArrow(_merged, "slice int, bits binary")
    out = np.zeros((SLICES, (1 << bits) // SLICES // 8), np.uint8)
    for i, cell in cells.collect():
        out[i] = np.frombuffer(cell, np.uint8)
    return names.sparkSession.sparkContext.broadcast(out.ravel())


def _passes(filter_bits: np.ndarray, names: np.ndarray, bits: int) -> np.ndarray:
    """Which names may be in the filter; most are settled by the first of their places."""
    size = (1 << bits) // SLICES
    left = np.arange(len(names))
    mixed_names = mixed(names)
    base = (names % np.uint64(SLICES)).astype(np.int64) * size
    for shift in PLACES:
        at = base[left] + ((mixed_names[left] >> np.uint64(shift)) % np.uint64(size)).astype(np.int64)
        left = left[((filter_bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(np.bool_)]
    return left


def _rolling(words: np.ndarray, at: np.ndarray, window: int, step: tuple[np.uint64, np.uint64] = (_STEP, _BACK)) -> np.ndarray:
    """A 64-bit hash of each window, from running sums: constant work per window."""
    powers = np.full(len(words) + 1, step[0])
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers[:-1], dtype=np.uint64)))
    back = np.full(len(words) + 1, step[1])
    back[0] = 1
    return mixed((sums[at + window] - sums[at]) * np.cumprod(back, dtype=np.uint64)[at])


def _digests(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """32 more bits for each window: of a rolling hash with another factor over words mixed anew."""
    other = mixed(words ^ _OTHER)
    return (_rolling(other, at, window, (_OTHER_STEP, _OTHER_BACK)) >> np.uint64(32)).astype(np.uint32).view(np.int32).astype(np.int64)


def _long_digests(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64 and 32 bits of a hash of word stretches, as an array of shape (n, 2)."""
    data, digest = memoryview(words.tobytes()), xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(data[8 * a : 8 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]), np.int64).reshape(-1, 2)
    return np.stack([both[:, 0], both[:, 1].astype(np.int32).astype(np.int64)], axis=1)


def _rows(hashes: np.ndarray, n: np.ndarray, keys: np.ndarray | None, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    none = keys is None
    k = [pa.nulls(len(hashes), pa.int64())] * 2 if none else [pa.array(keys[:, 0]), pa.array(keys[:, 1])]
    at = [pa.nulls(len(hashes), pa.int32())] * 2 if none else [pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(hashes[:, 0])), pa.array(hashes[:, 1].astype(np.int32)), pa.array(n.astype(np.int32)), *k, *at], NAMES)


def _settled(single: int, hashes: np.ndarray, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of one batch: what is there once asks (and counts ``single``); what is there more often is
    settled, as spans (n = 2, neighbouring ones joined) and one witness for each content."""
    if not len(hashes):
        return
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    h = hashes[order]
    new = np.ones(len(h), np.bool_)
    new[1:] = (h[1:] != h[:-1]).any(axis=1)
    group = np.cumsum(new) - 1
    often = np.bincount(group)[group] > 1
    one = order[~often]
    yield _rows(hashes[one], np.full(len(one), single), keys[one], lo[one], hi[one])
    head = order[often & new]
    yield _rows(hashes[head], np.full(len(head), 2), None, lo[head], hi[head])
    more = np.sort(order[often])  # back in the order of the texts
    if len(more):
        k, a, b = keys[more], lo[more], hi[more]
        begins = np.ones(len(more), np.bool_)
        begins[1:] = (k[1:] != k[:-1]).any(axis=1) | (a[1:] > b[:-1]) | (a[1:] < a[:-1])
        first = np.flatnonzero(begins)
        # What is settled needs no meeting: it is dealt by its place, not by a content many places share.
        place = np.stack([mixed(k[first, 0].view(np.uint64) + a[first].astype(np.uint64)).view(np.int64), k[first, 1].astype(np.int32).astype(np.int64)], axis=1)
        yield _rows(place, np.full(len(first), 2), k[first], a[first], np.maximum.reduceat(b, first))


def _long_symbols(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], axis=1)
            found: list[tuple[np.ndarray, ...]] = []
            for i, words, sizes in _parts(as_bytes(batch.column(2))):
                p = parse(words, sizes, window)
                ends = np.cumsum(sizes)
                doc = np.searchsorted(ends, p.node_start, side="right")
                base = ends[doc] - sizes[doc]
                found.append((_long_digests(words, p.node_start, p.node_end), keys[i + doc], p.node_start - base, p.node_end - base))
            if found:
                yield from _settled(1, *(np.concatenate(x) for x in zip(*found, strict=True)))

    return run


def _open_windows(window: int, bits: int, shared):
    """Asks: windows that cover an open word and whose anchor occurs more than once. Their own
    occurrence is left to the witnesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_bits = shared.value
        for batch in sliced(batches):
            keys = np.stack([np.asarray(batch.column("k1")), np.asarray(batch.column("k2"))], axis=1)
            spans = batch.column("spans").to_pylist()
            found: list[tuple[np.ndarray, ...]] = []
            for i, words, sizes in _parts(_unpacked(batch.column("packed"))):
                at = window_starts(sizes, window)
                if not len(at):
                    continue
                ends = np.cumsum(sizes)
                begins = ends - sizes
                is_open = np.ones(len(words) + 1, np.int64)
                is_open[0] = 0
                for j, own in enumerate(spans[i : i + len(sizes)]):
                    for s in own or ():
                        is_open[begins[j] + s["lo"] + 1 : begins[j] + s["hi"] + 1] = 0
                before = np.cumsum(is_open)
                at = at[before[at + window] > before[at]]
                at = at[_passes(filter_bits, _short(parse(words, sizes, window, at, nodes=False).anchor), bits)]
                doc = np.searchsorted(ends, at, side="right")
                hashes = np.stack([_rolling(words, at, window).view(np.int64), _digests(words, at, window)], axis=1)
                found.append((hashes, keys[i + doc], at - begins[doc], at - begins[doc] + window))
            if found:
                yield from _settled(0, *(np.concatenate(x) for x in zip(*found, strict=True)))

    return run


class _Seen:
    """How often a task has borne witness to a content, up to twice, for the latest content in each of a
    fixed number of places. Others bear witness again, which costs a row and changes no result."""

    def __init__(self, bits: int = 18) -> None:
        self.bits, self.held, self.times = bits, np.zeros((1 << bits, 2), np.int64), np.zeros(1 << bits, np.int64)

    def new(self, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which of the distinct contents (n times here) are still to be sent."""
        at = (hashes[:, 0].view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)
        times = np.where((self.held[at] == hashes).all(axis=1), self.times[at], 0)
        send = times < 2
        self.held[at], self.times[at] = hashes, times + n
        return send


def _witnesses(window: int, bits: int, asked):
    """Every window of the corpus that may be asked for, without its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_bits, seen = asked.value, _Seen()
        for batch in sliced(batches):
            found = [np.zeros((0, 2), np.int64)]
            for _, words, sizes in _parts(as_bytes(batch.column(0))):
                at = window_starts(sizes, window)
                rolling = _rolling(words, at, window)
                hit = _passes(asked_bits, rolling, bits)
                found.append(np.stack([rolling[hit].view(np.int64), _digests(words, at[hit], window)], axis=1))
            every = np.concatenate(found)
            order = np.lexsort((every[:, 1], every[:, 0]))
            h = every[order]
            head = np.ones(len(h), np.bool_)
            head[1:] = (h[1:] != h[:-1]).any(axis=1)
            first = np.flatnonzero(head)
            h, n = h[first], np.minimum(np.diff(np.append(first, len(h))), 2)
            send = seen.new(h, n)
            yield _rows(h[send], n[send], None, first[send], first[send])

    return run


@F.arrow_udf(BinaryType())
def _packed(texts: pa.Array) -> pa.Array:
    pack = zstandard.ZstdCompressor(level=3).compress
    return in_parts(lambda part: pa.array([None if t is None else pack(t) for t in as_bytes(part)], pa.binary()), texts)


def _unpacked(cells: pa.Array) -> list[bytes | None]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [None if c is None else unpack(c) for c in cells.to_pylist()]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of contents whose counts add up to two or more; rows come sorted by (h1, h2)."""
    held: list[pa.RecordBatch] = []

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        h = np.stack([table.column(c).to_numpy() for c in ("h1", "h2")], axis=1)
        new = np.ones(len(h), np.bool_)
        new[1:] = (h[1:] != h[:-1]).any(axis=1)
        group = np.cumsum(new) - 1
        often = np.bincount(group, weights=table.column("n").to_numpy())[group] > 1
        asks = table.column("k1").is_valid().to_numpy()
        out = table.filter(pa.array(often & asks))
        yield from out.select(["k1", "k2", "lo", "hi"]).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        first, last = ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for i in (0, batch.num_rows - 1))
        if first == last:
            continue
        table = pa.Table.from_batches(held)
        h = np.stack([table.column(c).to_numpy() for c in ("h1", "h2")], axis=1)
        cut = int(np.flatnonzero((h[1:] != h[:-1]).any(axis=1))[-1]) + 1
        yield from flush(table.slice(0, cut))
        held = table.slice(cut).to_batches()
    if held:
        yield from flush(pa.Table.from_batches(held))


def _checked(rows: DataFrame) -> DataFrame:
    return rows.repartition("h1").sortWithinPartitions("h1", "h2").mapInArrow(_repeated, "k1 bigint, k2 bigint, lo int, hi int")


def _with_spans(dealt: DataFrame, spans: DataFrame) -> DataFrame:
    own = spans.groupBy(F.col("k1").alias("j1"), F.col("k2").alias("j2")).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return dealt.join(own, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")), "left").select("k1", "k2", "id", "packed", "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 35, filter_bits: int = 27) -> DataFrame:
    """Remove every word that lies in a run of ``window`` words which also starts elsewhere.

    Words are maximal runs without ASCII white space. Returns ``id_col``, n_words, n_removed and
    kept_text (the kept words joined by one space). Windows are judged on the input and never cross
    documents; a run that overlaps itself counts as elsewhere. Null and empty texts have no words;
    texts shorter than the window keep all; every row is a text of its own, so repeated rows remove each
    other and ties need no rule; texts are read whole, however long; ids may be null; columns of other
    names are not read; an empty table gives an empty result.
    """
    text = F.col(text_col).cast("binary")
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.lit(1), F.col(id_col), text).alias("k1"), F.xxhash64(text, F.col(id_col), F.lit(2)).alias("k2"))

    names = docs.select(text).mapInArrow(_anchors(window), "name bigint")
    shared = _filter(names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), filter_bits)

    symbols = stored(_checked(keyed.select("k1", "k2", "text").mapInArrow(_long_symbols(window), ROWS)), "long-symbols")
    dealt = keyed.select("k1", "k2", "id", _packed("text").alias("packed"))
    asks = _with_spans(dealt, symbols).mapInArrow(_open_windows(window, filter_bits, shared), ROWS)
    asks = stored(asks, "asked-windows")
    asked = _filter(asks.where("k1 is not null and n = 0").select("h1"), filter_bits)
    spans = _checked(asks.unionByName(docs.select(text).mapInArrow(_witnesses(window, filter_bits, asked), ROWS)))

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept_text:string>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return in_parts(cut_some, texts, spans)

    def cut_some(texts: pa.Array, spans: pa.Array) -> pa.Array:
        n_words, n_removed, kept = [], [], []
        for text, own in zip(_unpacked(texts), spans.to_pylist(), strict=True):
            words = (text or b"").split()
            n_words.append(len(words))
            if own:
                gone = np.zeros(len(words), np.bool_)
                for s in own:
                    gone[s["lo"] : s["hi"]] = True
                words = [words[i] for i in np.flatnonzero(~gone).tolist()]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept_text"])

    out = _with_spans(dealt, symbols.unionByName(spans)).withColumn("cut", cut.asNondeterministic()("packed", "spans"))
    return out.select(F.col("id").alias(id_col), "cut.n_words", "cut.n_removed", "cut.kept_text")
