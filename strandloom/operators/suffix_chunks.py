"""Suffix ranks by prefix doubling over packed arrays.

Whole sequences are dealt into chunks of about CHUNK letters, ranks into ranges. A chunk holds the ranks of
all its suffixes, so it looks up the rank ``h`` letters ahead by itself. It asks each range with the sorted
distinct keys of its tied suffixes and how often each occurs; the range answers with the new ranks in the
same order. A message is one row of packed numbers, and a key that many suffixes share is one number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import TERMINATOR, Alphabet
from .ranking import forget, kept, numbered

CHUNK = 1 << 21  # letters of a chunk
LONGEST = 1 << 24  # letters of the longest sequence that is held in one chunk
MOST = 1 << 31  # ranks are halves of unsigned 32-bit numbers
SAMPLE = 50_000  # keys that set the ranges
BATCH = 1 << 17  # rows of the table that are handed over at a time
FEW_SEQUENCES = 1_000_000  # sequence ranks that are broadcast

_ROWS = "chunk int, range int, n bigint, a binary, b binary, c binary"
_SCHEMA = pa.schema([("chunk", pa.int32()), ("range", pa.int32()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _codes(alphabet: Alphabet) -> np.ndarray:
    table = np.zeros(256, np.int64)
    for i, c in enumerate(alphabet.letters):
        table[ord(c)] = i + 1
    return table


def letters_in_key(alphabet: Alphabet) -> int:
    base, n = len(alphabet.letters) + 1, 1
    while base ** (n + 1) < 1 << 63:
        n += 1
    return n


def _keys(codes: np.ndarray, base: int, k: int) -> np.ndarray:
    """The number of the ``k`` codes from each place on; places behind the end count as 0."""
    out, done, power, width = np.zeros(len(codes), np.int64), 0, codes, 1
    while True:
        if k & width:  # what is done stands before the next ``width`` codes
            out *= base**width
            out[: len(out) - done] += power[done:] if done else power
            done += width
        if done == k:
            return out
        ahead = np.zeros_like(power)
        ahead[: max(0, len(power) - width)] = power[width:]
        power, width = power * base**width + ahead, 2 * width


def _packed(*xs: np.ndarray) -> bytes:
    return np.concatenate([x.astype(np.int64) for x in xs]).tobytes()


def _asks(chunk: int, keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> list[tuple]:
    """One row for each range; ``keys`` are sorted, ``bounds`` are the first keys of all ranges but the first."""
    cuts = np.searchsorted(keys, bounds, "left")
    out = []
    for r, (k, n) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts), strict=True)):
        if len(k):
            out.append((chunk, r, int(n.sum()), k.tobytes(), n.astype(np.uint32).tobytes(), None))
    return out


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _held(meta: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """sid, term_order, length and first place of the sequences of a chunk."""
    sid, term, size = np.frombuffer(meta, np.int64).reshape(3, -1)
    return sid, term, size, np.cumsum(size) - size


def suffix_rows(ranks: DataFrame, alphabet: Alphabet) -> DataFrame | None:
    """(row, sid, srank, pos, bwt, lf) for ``ranks`` (sid, s, term_order), or None where a sequence is longer
    than LONGEST or the suffixes are more than MOST."""
    size = F.octet_length("s")
    nseq, total, longest = ranks.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    if longest > LONGEST or total + nseq >= MOST:
        return None
    base, width, codes = len(alphabet.letters) + 1, letters_in_key(alphabet), _codes(alphabet)
    chunks = max(1, -(-total // CHUNK))
    stride = max(1, total // SAMPLE)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array([base**i for i in range(width - 1, -1, -1)], np.int64)
        left = 0
        for batch in batches:
            found = []
            for s in batch.column(0).to_pylist():
                if len(s) > left:
                    text = np.concatenate([codes[np.frombuffer(s, np.uint8)], np.zeros(width, np.int64)])
                    at = np.arange(left, len(s), stride)
                    found.append((text[at[:, None] + np.arange(width)] * weights).sum(1))
                left = (left - len(s)) % stride
            yield pa.record_batch([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["key"])

    texts = ranks.select(F.coalesce("s", F.lit("")).cast("binary").alias("s"))
    keys = np.sort(np.array([r[0] for r in texts.mapInArrow(sample, "key bigint").collect()], np.int64))
    bounds = np.unique(keys[np.arange(1, chunks) * len(keys) // chunks]) if len(keys) else keys
    ranges = len(bounds) + 1

    def start(table: pa.Table) -> pa.Table:
        table = table.sort_by("term_order")
        chunk, texts = table["chunk"][0].as_py(), table["s"].to_pylist()
        size = np.array([len(s) for s in texts], np.int64)
        gap = bytes(width)  # the terminator and more behind every text
        padded = np.frombuffer(gap.join(texts) + gap, np.uint8)
        real = np.arange(size.sum()) + np.repeat(np.arange(len(size)) * width, size)
        coded = codes[padded]
        if len(real) and coded[real].min() == 0:
            raise ValueError("a text has letters that are not in the alphabet")
        keys, inverse, counts = np.unique(_keys(coded, base, width)[real], return_inverse=True, return_counts=True)
        held = _packed(table["sid"].to_numpy(), table["term_order"].to_numpy(), size)
        return _table([(chunk, -1, 0, held, b"".join(texts), (inverse.astype(np.uint32) << 1 | 1).tobytes()), *_asks(chunk, keys, counts, bounds)])

    dealt = ranks.select(F.pmod(F.xxhash64("term_order"), F.lit(chunks)).cast("int").alias("chunk"), "sid", "term_order", F.coalesce("s", F.lit("")).cast("binary").alias("s"))
    state = kept(dealt.repartition(chunks, "chunk").groupBy("chunk").applyInArrow(start, _ROWS), "chunks")
    sizes = dict(state.where("range >= 0").groupBy("range").agg(F.sum("n")).collect())
    bases = np.concatenate([[0], np.cumsum([sizes.get(r, 0) for r in range(ranges)])]).astype(np.int64)

    def answers(first: bool):
        def answer(table: pa.Table) -> pa.Table:
            own = table["range"][0].as_py()
            parts = [np.frombuffer(x, np.int64) for x in table["a"].to_pylist()]
            counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table["b"].to_pylist()])
            keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            rows = np.bincount(inverse, weights=counts).astype(np.int64)
            before = np.cumsum(rows) - rows
            if first:
                rank = bases[own] + before
            else:
                old = keys >> 32
                rank = old + before - before[np.searchsorted(keys, old << 32)]
            new = (rank.astype(np.uint32) << 1 | (rows > 1))[inverse].astype(np.uint32)
            cuts = np.split(new, np.cumsum([len(x) for x in parts])[:-1])
            return _table([(c, own, 0, None, None, x.tobytes()) for c, x in zip(table["chunk"].to_pylist(), cuts, strict=True)])

        return answer

    def steps(h: int):
        def step(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["range"])
            held, replies = rows[0], [np.frombuffer(r["c"], np.uint32) for r in rows[1:]]
            rank = np.frombuffer(held["c"], np.uint32).copy()
            if replies:
                tied = np.flatnonzero(rank & 1)
                rank[tied] = np.concatenate(replies)[rank[tied] >> 1]
            at = np.flatnonzero(rank & 1)
            asks = []
            if len(at):
                _, term, size, first = _held(held["a"])
                # Empty sequences share their place with the next one, so ends tell the sequences apart.
                own = np.searchsorted(first + size, at, "right")
                ahead = at + h
                there = ahead < (first + size)[own]
                following = np.where(there, (rank[np.where(there, ahead, 0)] >> 1).astype(np.int64) + nseq, term[own])
                keys, inverse, counts = np.unique((rank[at] >> 1).astype(np.int64) << 32 | following, return_inverse=True, return_counts=True)
                rank[at] = inverse.astype(np.uint32) << 1 | 1
                asks = _asks(held["chunk"], keys, counts, bases[1:-1] << 32)
            return _table([(held["chunk"], -1, 0, held["a"], held["b"], rank.tobytes()), *asks])

        return step

    h, first = width, True
    while True:
        asks = state.where("range >= 0")
        if asks.select("n").isEmpty():
            break
        replies = kept(asks.repartition(ranges, "range").groupBy("range").applyInArrow(answers(first), _ROWS), "answers")
        both = state.where("range < 0").unionByName(replies).repartition(chunks, "chunk")
        new = kept(both.groupBy("chunk").applyInArrow(steps(h), _ROWS), "chunks")
        forget(state, replies)
        state, h, first = new, 2 * h, False
    return _rows(state, nseq, alphabet)


def _rows(state: DataFrame, nseq: int, alphabet: Alphabet) -> DataFrame:
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                _, term, size, first = _held(r["a"])
                rank = np.append(np.frombuffer(r["c"], np.uint32) >> 1, 0).astype(np.int64)
                top = np.where(size > 0, rank[first], -1)
                yield pa.record_batch([pa.array(np.full(len(term), r["chunk"], np.int32)), pa.array(term), pa.array(top)], ["chunk", "term_order", "top"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "sid", "srank", "pos", "bwt", "lf"]
        for batch in batches:
            for r in batch.to_pylist():
                sid, term, size, first = _held(r["a"])
                srank = np.array([x["srank"] for x in sorted(r["sranks"], key=lambda x: x["term_order"])], np.int64)
                row = (np.frombuffer(r["c"], np.uint32) >> 1).astype(np.int64) + nseq
                text = np.frombuffer(r["b"], np.uint8)
                # All rows of a sequence stand together, its terminator last: the row before is that of the longer suffix.
                i = 0
                while i < len(size):
                    j = max(i + 1, int(np.searchsorted(np.cumsum(size[i:] + 1), BATCH, "right")) + i)
                    own, n = np.repeat(np.arange(i, j), size[i:j] + 1), size[i:j]
                    begin = np.cumsum(n + 1) - (n + 1)
                    pos = np.arange(len(own)) - begin[own - i]
                    last = pos == size[own]
                    lo, hi = first[i], first[j - 1] + size[j - 1]
                    rows = np.empty(len(own), np.int64)
                    rows[~last], rows[last] = row[lo:hi], term[i:j]
                    letters = np.empty(len(own), np.uint8)
                    letters[~last] = text[lo:hi]
                    head = pos == 0
                    lf = np.roll(rows, 1)
                    lf[head] = srank[i:j]
                    bwt = np.roll(letters, 1)
                    bwt[head] = ord(TERMINATOR)
                    offsets = pa.py_buffer(np.arange(len(own) + 1, dtype=np.int32))
                    shown = pa.StringArray.from_buffers(len(own), offsets, pa.py_buffer(bwt.tobytes()))
                    yield pa.record_batch([pa.array(rows), pa.array(sid[own]), pa.array(srank[own]), pa.array(pos), shown, pa.array(lf)], names)
                    i = j

    held = state.where("range < 0")
    tops = held.select("chunk", "a", "c").mapInArrow(heads, "chunk int, term_order bigint, top bigint")
    order = numbered(tops, ["top", "term_order"], "srank")
    order = kept(order.groupBy("chunk").agg(F.collect_list(F.struct("term_order", "srank")).alias("sranks")), "sranks")
    rows = held.select("chunk", "a", "b", "c").join(F.broadcast(order) if nseq <= FEW_SEQUENCES else order, "chunk")
    out = rows.mapInArrow(emit, "row bigint, sid bigint, srank bigint, pos bigint, bwt string, lf bigint")
    out.packed = Packed(held, alphabet, nseq)
    return out


class Packed:
    """What a table of ``suffix_rows`` is made of, as its attribute ``packed``."""

    def __init__(self, held: DataFrame, alphabet: Alphabet, nseq: int) -> None:
        self.held, self.alphabet, self.nseq = held, alphabet, nseq

    def intervals(self, lengths: list[int], words: list[str] | None = None) -> DataFrame | None:
        """(word, lo, width) of all words of the given lengths, or of those in ``words``; None if one is longer
        than a key. Each chunk sends one row for each of its words."""
        base, codes, nseq, most = len(self.alphabet.letters) + 1, _codes(self.alphabet), self.nseq, letters_in_key(self.alphabet)
        if not lengths or max(lengths) > most:
            return None
        letters = self.alphabet.letters
        asked = None
        if words is not None:
            asked = {k: np.array(sorted(sum(int(codes[ord(c)]) * base ** (k - 1 - i) for i, c in enumerate(w)) for w in set(words) if len(w) == k and all(c in letters for c in w)), np.int64) for k in lengths}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    _, _, size, first = _held(r["a"])
                    row = (np.frombuffer(r["c"], np.uint32) >> 1).astype(np.int64) + nseq
                    coded = codes[np.frombuffer(r["b"], np.uint8)]
                    rest = np.repeat(first + size, size) - np.arange(len(coded))  # letters up to the end
                    for k in lengths:
                        at = rest >= k
                        keys, rows = _keys(coded, base, k)[at], row[at]
                        if asked is not None:
                            place = np.searchsorted(asked[k], keys)
                            hit = place < len(asked[k])
                            hit[hit] = asked[k][place[hit]] == keys[hit]
                            keys, rows = keys[hit], rows[hit]
                        if not len(keys):
                            continue
                        order = np.argsort(keys, kind="stable")
                        keys, starts = np.unique(keys[order], return_index=True)
                        lows = np.minimum.reduceat(rows[order], starts)
                        widths = np.diff(np.append(starts, len(order)))
                        digits = keys[:, None] // base ** np.arange(k - 1, -1, -1, dtype=np.int64) % base
                        shown = np.frombuffer(("?" + letters).encode(), np.uint8)[digits].tobytes().decode()
                        yield pa.record_batch([pa.array([shown[i : i + k] for i in range(0, len(shown), k)], pa.string()), pa.array(lows), pa.array(widths.astype(np.int64))], ["word", "lo", "width"])

        parts = self.held.select("a", "b", "c").mapInArrow(count, "word string, lo bigint, width bigint")
        return parts.groupBy("word").agg(F.min("lo").alias("lo"), F.sum("width").alias("width"))
