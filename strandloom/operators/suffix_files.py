"""The suffix table from one mapped file of letters, for alphabets of up to five letters.

The texts stand in terminator order in one file of the shared folder, a byte a letter, and GAP zeros behind
each; tasks map it, so it is no process's own memory. Places are dealt into ranges by their first KEY
letters and sent as gaps of sorted lists; a range sorts its places and makes rows in row order. LF rows come
from counts of letters by range, so no table of ranks by place is ever stored.

Places that agree in KEY letters are told apart by their anchors: the anchor of a place is the first of the
SPAN places from it on whose GRAM letters hash lowest, which KEY letters determine, so such places have their
anchors at one distance and the order of those. Only anchors, about one place in eight, are ranked, by prefix
doubling over the chain of anchors: chunks ask ranges with sorted distinct keys as in ``suffix_chunks``.
A byte holds the letter (3 bits) and the distance of the anchor (4 bits).
"""

from __future__ import annotations

import os
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import TERMINATOR, Alphabet
from . import suffix_chunks
from .ranking import forget, forget_folder, kept, kept_folder
from .suffix_chunks import _ROWS, FEW_SEQUENCES, LONGEST, MOST, _asks, _codes, _keys, _table

KEY = 24  # letters of a key: 6 ** 24 < 2 ** 63
GRAM, SPAN = 9, 15  # KEY letters from an anchor on hold the SPAN windows of GRAM letters behind it
GAP = KEY  # zeros behind every text
PAGE = 4096  # chunks of the file start at multiples, so no two tasks write to one page
SAMPLE = 100_000  # keys that set the ranges
LARGEST = 3  # a range of over so many times CHUNK places is left to suffix_chunks

_TYPES = {"row": "bigint", "sid": "bigint", "srank": "bigint", "pos": "bigint", "bwt": "string", "lf": "bigint"}


class Files:
    """Paths and layout of a table's files."""

    def __init__(self, folder: str, base: int, offsets: np.ndarray, sizes: np.ndarray) -> None:
        self.folder, self.base, self.offsets, self.sizes = folder, base, offsets, sizes

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def save(self, name: str, x: np.ndarray) -> None:
        """In one step, so a task that runs twice does no harm."""
        own = self.path(f"{name}-{uuid.uuid4().hex}")
        with open(own, "wb") as f:
            np.save(f, x)
        os.replace(own, self.path(name))

    def load(self, name: str) -> np.ndarray:
        return np.load(self.path(name), mmap_mode="r")

    def drop(self, name: str) -> None:
        if os.path.exists(self.path(name)):
            os.remove(self.path(name))

    def text(self) -> np.ndarray:
        return np.memmap(self.path("text"), np.uint8, "r")

    def letters(self, chunk: int) -> np.ndarray:
        at = self.offsets[chunk]
        return self.text()[at : at + self.sizes[chunk]] & 7

    def write(self, chunk: int, x: np.ndarray) -> None:
        file = os.open(self.path("text"), os.O_WRONLY)
        try:
            left, at = memoryview(x.tobytes()), int(self.offsets[chunk])
            while left:
                n = os.pwrite(file, left, at)
                left, at = left[n:], at + n
        finally:
            os.close(file)

    def keys(self, places: np.ndarray) -> np.ndarray:
        """The keys of KEY letters at ``places``: eight letters are read as one number, then joined in pairs."""
        text, b = self.text(), self.base
        words = np.ndarray((len(text) - 7,), "<u8", buffer=text, strides=(1,))
        out = np.zeros(len(places), np.int64)
        for i in range(0, KEY, 8):
            x = words[places + i] & np.uint64(0x0707070707070707)
            x = (x * np.uint64(b) + (x >> np.uint64(8))) & np.uint64(0x00FF00FF00FF00FF)
            x = (x * np.uint64(b**2) + (x >> np.uint64(16))) & np.uint64(0x0000FFFF0000FFFF)
            x = (x * np.uint64(b**4) + (x >> np.uint64(32))) & np.uint64(0xFFFFFFFF)
            out = out * b**8 + x.astype(np.int64)
        return out

    def anchor_ranks(self, places: np.ndarray) -> np.ndarray:
        """The ranks of the anchors of ``places``, looked up in the order of places."""
        order = np.argsort(places)
        at = places[order]
        at = at + (self.text()[at] >> 4)
        out = np.empty(len(places), np.int64)
        out[order] = self.load("ranks.npy")[np.searchsorted(self.load("anchors.npy"), at.astype(np.uint32))]
        return out

    def sorted_places(self, places: np.ndarray) -> np.ndarray:
        """The order of ``places``, which must ascend: by key, then by place where a key holds a terminator,
        as texts stand in terminator order, or else by anchor."""
        keys = self.keys(places)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        tied = np.zeros(len(keys), bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied & (keys % self.base != 0))
        if len(at):
            group = np.cumsum(np.append(False, np.diff(keys[at]) != 0))
            order[at] = order[at][np.argsort(group << 32 | self.anchor_ranks(places[order[at]]))]
        return order


def _ahead(x: np.ndarray, d: int) -> np.ndarray:
    out = np.full_like(x, np.iinfo(np.int64).max)
    out[: max(0, len(x) - d)] = x[d:]
    return out


def _anchors(letters: np.ndarray, base: int) -> np.ndarray:
    """For each place the distance to its anchor."""
    grams = _keys(letters.astype(np.int64), base, GRAM).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    own = np.arange(len(letters))
    low = (grams >> np.uint64(26) << np.uint64(25)).astype(np.int64) | own  # the place tells equal hashes apart: the first is lowest
    done = 1
    while done < SPAN:
        d = min(done, SPAN - done)
        low, done = np.minimum(low, _ahead(low, d)), done + d
    return (low & ((1 << 25) - 1)) - own


def _gaps(places: np.ndarray) -> bytes:
    """Ascending numbers as the gaps between them: low bytes, high bytes and what is beyond, packed."""
    gaps = np.diff(places, prepend=0)
    small = np.minimum(gaps, 0xFFFF).astype(np.uint16)
    raw = np.concatenate([small.view(np.uint8).reshape(-1, 2).T.ravel(), gaps[gaps >= 0xFFFF].astype(np.int64).view(np.uint8)]).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _places(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    gaps = np.ascontiguousarray(raw[: 2 * n].reshape(2, n).T).view(np.uint16).ravel().astype(np.int64)
    gaps[gaps == 0xFFFF] = raw[2 * n :].copy().view(np.int64)
    return np.cumsum(gaps)


def suffix_rows(ordered: DataFrame, alphabet: Alphabet) -> DataFrame | None:
    """(row, sid, srank, pos, bwt, lf) for ``ordered`` (sid, s, term_order), or None where the alphabet, a
    sequence, the number of sequences or a range is too large, or where the shared folder is no plain one."""
    base, spark = len(alphabet.letters) + 1, ordered.sparkSession
    if base > 6:
        return None
    texts = ordered.select("sid", "term_order", F.coalesce("s", F.lit("")).cast("binary").alias("s"))
    size = F.length("s").cast("bigint")
    nseq, total, longest = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    if not total or nseq > FEW_SEQUENCES or longest > LONGEST or total + GAP * nseq >= MOST:
        return None
    folder = kept_folder(spark, "suffixes")
    if folder is None:
        return None

    seqs = texts.select("term_order", "sid", size.alias("size")).toArrow().sort_by("term_order")
    term, sid, sizes = (seqs[c].to_numpy() for c in ("term_order", "sid", "size"))
    before = np.cumsum(sizes + GAP) - (sizes + GAP)
    _, heads, chunk = np.unique(before // suffix_chunks.CHUNK, return_index=True, return_inverse=True)
    lengths = np.add.reduceat(sizes + GAP, heads)
    paged = -(-lengths // PAGE) * PAGE
    offsets = PAGE + np.cumsum(paged) - paged  # zeros stand before the first text, too
    chunks, start = len(heads), before - before[heads][chunk] + offsets[chunk]
    files = Files(folder, base, offsets, lengths)
    for name, x in (("start", start), ("size", sizes), ("sid", sid), ("term", term)):
        files.save(f"{name}.npy", x)
    with open(files.path("text"), "wb") as f:
        f.truncate(int(offsets[-1] + paged[-1] + PAGE))
    codes = _codes(alphabet).astype(np.uint8)

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("term_order")
        gap = bytes(GAP)
        raw = np.frombuffer(gap.join(table["s"].to_pylist()) + gap, np.uint8)
        coded = codes[raw]
        if np.count_nonzero(coded) < sum(len(x) for x in table["s"].to_pylist()):
            raise ValueError("a text has letters that are not in the alphabet")
        own = table["chunk"][0].as_py()
        files.write(own, coded)
        return pa.table([pa.array([own], pa.int32())], ["chunk"])

    firsts = F.array(*[F.lit(int(x)).cast("bigint") for x in term[heads][1:]])
    dealt = texts.withColumn("chunk", F.size(F.filter(firsts, lambda x: x <= F.col("term_order"))) if chunks > 1 else F.lit(0))
    dealt.repartition(chunks, "chunk").groupBy("chunk").applyInArrow(write, "chunk int").collect()
    forget(ordered)

    # Keys taken at even distances set the ranges; a key that fills one has it for itself.
    places = np.linspace(0, total - 1, min(SAMPLE, total)).astype(np.int64)
    own = np.searchsorted(np.cumsum(sizes), places, "right")
    sample = np.sort(files.keys(start[own] + places - (np.cumsum(sizes) - sizes)[own]))
    cuts = sample[np.arange(1, chunks) * len(sample) // chunks]
    bounds = np.unique(np.concatenate([cuts, cuts[1:][np.diff(cuts) == 0] + 1]))
    ranges = len(bounds) + 1
    every = spark.range(0, chunks, 1, chunks)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in (x for batch in batches for x in batch.column(0).to_pylist()):
            letters = files.letters(c)
            keys = _keys(letters.astype(np.int64), base, KEY)
            real = np.flatnonzero(letters)
            # Letters before the places of each range; row 0 is that of the terminators.
            counts = np.bincount((np.searchsorted(bounds, keys[real], "right") + 1) * 8 + np.append(np.uint8(0), letters)[real], minlength=(ranges + 1) * 8)
            last = np.append(np.uint8(0), letters)[start[chunk == c] + sizes[chunk == c] - offsets[c]]
            counts[:8] += np.bincount(last, minlength=8)
            files.save(f"counts-{c}.npy", counts.reshape(-1, 8))
            distance = _anchors(letters, base)
            files.write(c, letters | distance.astype(np.uint8) << 4)
            # An anchor's successor is that of the place behind it.
            ends = _ahead(np.where(letters == 0, np.arange(len(letters)), np.iinfo(np.int64).max), 0)
            ends = np.minimum.accumulate(ends[::-1])[::-1]
            rest = ends - np.arange(len(letters))
            windows = np.flatnonzero(rest >= SPAN)
            marked = np.zeros(len(letters), bool)
            marked[windows + distance[windows]] = True
            at = np.flatnonzero(marked)
            number = np.cumsum(marked) - 1
            following = np.minimum(at + 1, len(letters) - 1)
            step = np.where(rest[at] >= KEY, number[following + distance[following]] - np.arange(len(at)), 0)
            files.save(f"at-{c}.npy", at.astype(np.uint32))
            files.save(f"next-{c}.npy", step.astype(np.uint8))
            distinct, inverse, n = np.unique(keys[at], return_inverse=True, return_counts=True)
            files.save(f"ranks-0-{c}.npy" if len(at) else f"ranks-{c}.npy", inverse.astype(np.uint32) << 1 | 1)
            yield from _table(_asks(c, distinct, n, bounds)).to_batches()

    def answers(first: bool) -> Callable[[pa.Table], pa.Table]:
        def answer(table: pa.Table) -> pa.Table:
            parts = [np.frombuffer(x, np.int64) for x in table["a"].to_pylist()]
            counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table["b"].to_pylist()])
            keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            rows = np.bincount(inverse, weights=counts).astype(np.int64)
            rank = np.cumsum(rows) - rows  # in the first round within the range
            if not first:
                old = keys >> 32
                rank = old + rank - rank[np.searchsorted(keys, old << 32)]
            new = (rank.astype(np.uint32) << 1 | (rows > 1))[inverse].astype(np.uint32)
            cuts, own = np.split(new, np.cumsum([len(x) for x in parts])[:-1]), table["range"][0].as_py()
            return _table([(c, own, int(rows.sum()), None, None, x.tobytes()) for c, x in zip(table["chunk"].to_pylist(), cuts, strict=True)])

        return answer

    def steps(k: int, bases: np.ndarray) -> Callable[[pa.Table], pa.Table]:
        def step(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["range"])
            c = rows[0]["chunk"]
            rank = np.array(files.load(f"ranks-{k}-{c}.npy"))
            tied = np.flatnonzero(rank & 1)
            replies = [np.frombuffer(r["c"], np.uint32) + (np.uint32(bases[r["range"]] << 1) if not k else np.uint32(0)) for r in rows]
            rank[tied] = np.concatenate(replies)[rank[tied] >> 1]
            at = np.flatnonzero(rank & 1)
            if not len(at):
                files.save(f"ranks-{c}.npy", rank)
                return _table([])
            steps_ = files.load(f"next-{c}.npy").astype(np.int64)
            jump = np.arange(len(rank)) + steps_
            for _ in range(k):
                jump = jump[jump]
            following = (rank[jump[at]] >> 1).astype(np.int64) + nseq
            ends = steps_[at] == 0  # tied after the first key only: the terminators tell them apart
            following[ends] = np.searchsorted(files.load("start.npy"), files.load(f"at-{c}.npy")[at[ends]].astype(np.int64) + offsets[c], "right") - 1
            keys, inverse, n = np.unique((rank[at] >> 1).astype(np.int64) << 32 | following, return_inverse=True, return_counts=True)
            rank[at] = inverse.astype(np.uint32) << 1 | 1
            files.save(f"ranks-{k + 1}-{c}.npy", rank)
            return _table(_asks(c, keys, n, bases[1:-1] << 32))

        return step

    def answered(asks: DataFrame, first: bool) -> DataFrame:
        return kept(asks.repartition(ranges, "range").groupBy("range").applyInArrow(answers(first), _ROWS), "answers")

    replies = answered(every.mapInArrow(begin, _ROWS), True)
    counts = sum(files.load(f"counts-{c}.npy") for c in range(chunks))
    if counts[1:].sum(1).max() > LARGEST * suffix_chunks.CHUNK:
        forget(replies)
        forget_folder(folder)
        return None
    found = dict(replies.groupBy("range").agg(F.max("n")).collect())
    bases = np.concatenate([[0], np.cumsum([found.get(r, 0) for r in range(ranges)])]).astype(np.int64)
    k = 0
    while not replies.isEmpty():
        new = answered(replies.repartition(chunks, "chunk").groupBy("chunk").applyInArrow(steps(k, bases), _ROWS), False)
        forget(replies)
        for c in range(chunks):
            files.drop(f"ranks-{k}-{c}.npy")
        replies, k = new, k + 1
    forget(replies)

    # One list of anchors and one of their ranks, chunk by chunk.
    sizes_ = [len(files.load(f"at-{c}.npy")) for c in range(chunks)]
    for name in ("anchors", "ranks"):
        out = np.lib.format.open_memmap(files.path(f"{name}.npy"), "w+", np.uint32, (sum(sizes_),))
        done = 0
        for c, n in enumerate(sizes_):
            out[done : done + n] = files.load(f"at-{c}.npy") + np.uint32(offsets[c]) if name == "anchors" else files.load(f"ranks-{c}.npy") >> 1
            done += n
        out.flush()
        del out
    for c in range(chunks):
        for name in ("at", "next", "ranks", "counts"):
            files.drop(f"{name}-{c}.npy")

    full = np.flatnonzero(sizes)
    first = start[full]
    second = np.where(sizes[full] < KEY, first, 0)
    long = sizes[full] >= KEY
    second[long] = files.anchor_ranks(first[long])
    srank = np.empty(nseq, np.int64)
    srank[np.flatnonzero(sizes == 0)] = np.arange(nseq - len(full))
    srank[full[np.lexsort((second, files.keys(first)))]] = np.arange(nseq - len(full), nseq)
    files.save("srank.npy", srank)
    packed = Packed(spark, files, alphabet, nseq, bounds, counts)
    out = packed.rows(list(_TYPES))
    out.packed = packed
    return out


class Packed:
    """What a table of ``suffix_rows`` is made of, as its attribute ``packed``."""

    def __init__(self, spark, files: Files, alphabet: Alphabet, nseq: int, bounds: np.ndarray, counts: np.ndarray) -> None:
        self.spark, self.files, self.alphabet, self.nseq, self.bounds, self.counts = spark, files, alphabet, nseq, bounds, counts
        self.first = np.cumsum(counts.sum(1)) - counts.sum(1)  # first row of the terminators and of each range
        every = counts.sum(0)
        self.starts = np.concatenate([[0], nseq + np.cumsum(every[1:]) - every[1:]]).astype(np.int64)  # by letter
        self.occ = np.cumsum(counts, 0) - counts

    def _ranges(self, made: Callable[[int, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``made`` gives for each range and its ascending places; range -1 is that of the terminators."""
        files, bounds, base = self.files, self.bounds, self.files.base

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c in (x for batch in batches for x in batch.column(0).to_pylist()):
                letters = files.letters(c)
                real = np.flatnonzero(letters)
                owner = np.searchsorted(bounds, _keys(letters.astype(np.int64), base, KEY)[real], "right").astype(np.uint16 if len(bounds) < 1 << 16 else np.int64)
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(len(bounds) + 2))
                rows = [(c, -1, 0, None, None, None)] if c == 0 else []
                for r in np.flatnonzero(np.diff(cuts)):
                    rows.append((c, int(r), int(cuts[r + 1] - cuts[r]), _gaps(real[order[cuts[r] : cuts[r + 1]]]), None, None))
                yield from _table(rows).to_batches()

        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = defaultdict(list)
            for batch in batches:
                for r in batch.select(["chunk", "range", "n", "a"]).to_pylist():
                    parts[r["range"]].append((r["chunk"], r["n"], r["a"]))
            for r, own in parts.items():
                yield from made(r, np.concatenate([files.offsets[c] + _places(a, n) for c, n, a in sorted(own)]) if r >= 0 else np.zeros(0, np.int64))

        chunks, ranges = len(files.offsets), len(bounds) + 1
        return self.spark.range(0, chunks, 1, chunks).mapInArrow(send, _ROWS).repartition(ranges + 1, "range").mapInArrow(take, schema)

    def _sorted(self, made: Callable[[int, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``made`` gives for each range, its places and their sequences, by row, and the letters before them."""
        files = self.files

        def rows(r: int, places: np.ndarray) -> Iterator[pa.RecordBatch]:
            start = files.load("start.npy")
            if r < 0:
                places, own = start + files.load("size.npy"), np.arange(len(start))
            else:
                own = np.searchsorted(start, places, "right") - 1
                order = files.sorted_places(places)
                places, own = places[order], own[order]
            yield from made(r, places, own, files.text()[places - 1] & 7)

        return self._ranges(rows, schema)

    def rows(self, columns: list[str], every: int = 0, letters: bool = False) -> DataFrame:
        """The columns of all rows; with ``every`` only of each such row behind the terminators, with
        ``letters`` only of rows with a letter before their suffix."""
        files, first, starts, occ, base, batch = self.files, self.first, self.starts, self.occ, self.files.base, suffix_chunks.BATCH
        shown = np.frombuffer((TERMINATOR + self.alphabet.letters).encode(), np.uint8)

        def made(r: int, places: np.ndarray, own: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
            lf = None
            if "lf" in columns:
                lf = np.empty(len(places), np.int64)
                for c in range(base):
                    at = np.flatnonzero(before == c)
                    lf[at] = starts[c] + occ[r + 1, c] + np.arange(len(at))
            row = first[r + 1] + np.arange(len(places))
            if every or letters:
                keep = np.flatnonzero(before) if letters else np.flatnonzero(row % every == 0) if r >= 0 else np.zeros(0, np.int64)
                row, places, own, before, lf = row[keep], places[keep], own[keep], before[keep], None if lf is None else lf[keep]
            start, sid, srank = (files.load(f"{x}.npy") for x in ("start", "sid", "srank"))
            for i in range(0, len(row), batch):
                part = slice(i, i + batch)
                out = []
                for c in columns:
                    if c == "bwt":
                        x = shown[before[part]]
                        out.append(pa.StringArray.from_buffers(len(x), pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32)), pa.py_buffer(x.tobytes())))
                    elif c == "row":
                        out.append(pa.array(row[part]))
                    elif c == "lf":
                        out.append(pa.array(lf[part]))
                    else:
                        x = own[part]
                        out.append(pa.array(sid[x] if c == "sid" else srank[x] if c == "srank" else places[part] - start[x]))
                yield pa.record_batch(out, columns)

        return self._sorted(made, ", ".join(f"{c} {_TYPES[c]}" for c in columns))

    def bwt(self) -> DataFrame:
        """(row, codes): the letters of all rows as codes, in pieces with their first rows."""
        first = self.first

        def made(r: int, places: np.ndarray, own: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(before), suffix_chunks.BATCH):
                yield pa.record_batch([pa.array([first[r + 1] + i], pa.int64()), pa.array([before[i : i + suffix_chunks.BATCH].tobytes()], pa.binary())], ["row", "codes"])

        return self._sorted(made, "row bigint, codes binary")

    def bwt_rows(self, bwt: DataFrame) -> DataFrame:
        """(row, bwt) from the pieces of ``bwt``."""
        shown = np.frombuffer((TERMINATOR + self.alphabet.letters).encode(), np.uint8)

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    x = shown[np.frombuffer(r["codes"], np.uint8)]
                    yield pa.record_batch([pa.array(r["row"] + np.arange(len(x))), pa.array(list(x.tobytes().decode()), pa.string())], ["row", "bwt"])

        return bwt.mapInArrow(unpack, "row bigint, bwt string")

    def ranks(self, bwt: DataFrame, rows: list[int]) -> dict[int, np.ndarray]:
        """For each number in ``rows`` the first rows that each code's suffixes before it map to, from the
        pieces of ``bwt``. What is collected is a count for each of the numbers."""
        rows = np.unique(rows)
        base = self.files.base

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((len(rows), base), np.int64)  # between the number before and this one
            for batch in batches:
                for r in batch.to_pylist():
                    codes = np.frombuffer(r["codes"], np.uint8)
                    # Row x is before the number k if x < k: it counts for the first number above it.
                    cuts = np.clip(rows - r["row"], 0, len(codes))
                    for i in range(int(np.searchsorted(rows, r["row"], "right")), len(rows)):
                        lo = cuts[i - 1] if i else 0
                        found[i] += np.bincount(codes[lo : cuts[i]], minlength=base)
                        if cuts[i] == len(codes):
                            break
            at = np.flatnonzero(found.any(1))
            yield pa.record_batch([pa.array(at), pa.array([x.tolist() for x in found[at]], pa.list_(pa.int64()))], ["i", "n"])

        total = np.zeros((len(rows), base), np.int64)
        for i, n in bwt.mapInArrow(count, "i bigint, n array<bigint>").collect():
            total[i] += np.array(n)
        return {int(k): self.starts[:base] + x for k, x in zip(rows, np.cumsum(total, 0), strict=True)}

    def intervals(self, lengths: list[int], words: list[str] | None = None) -> DataFrame | None:
        """(word, lo, width) of all words of the given lengths, or of those in ``words``; None if one is longer
        than a key. Each range sends one row for each of its words."""
        files, first, base, letters = self.files, self.first, self.files.base, self.alphabet.letters
        if not lengths or max(lengths) > KEY:
            return None
        codes, asked = _codes(self.alphabet), None
        if words is not None:
            asked = {k: np.array(sorted(sum(int(codes[ord(c)]) * base ** (k - 1 - i) for i, c in enumerate(w)) for w in set(words) if len(w) == k and all(c in letters for c in w)), np.int64) for k in lengths}

        def count(r: int, places: np.ndarray) -> Iterator[pa.RecordBatch]:
            keys = np.sort(files.keys(places)) if len(places) else places
            for k in lengths:
                found, at, n = np.unique(keys // base ** (KEY - k), return_index=True, return_counts=True)
                keep = found % base != 0
                if asked is not None:
                    keep &= np.isin(found, asked[k])
                found, at, n = found[keep], at[keep], n[keep]
                if len(found):
                    digits = found[:, None] // base ** np.arange(k - 1, -1, -1, dtype=np.int64) % base
                    shown = np.frombuffer((TERMINATOR + letters).encode(), np.uint8)[digits].tobytes().decode()
                    yield pa.record_batch([pa.array([shown[i : i + k] for i in range(0, len(shown), k)], pa.string()), pa.array(first[r + 1] + at), pa.array(n.astype(np.int64))], ["word", "lo", "width"])

        return self._ranges(count, "word string, lo bigint, width bigint").groupBy("word").agg(F.min("lo").alias("lo"), F.sum("width").alias("width"))

    def reconstruct(self) -> DataFrame:
        """(srank, s): each row's letter is sent to the chunk of its sequence, to the place before its own."""
        files, first = self.files, np.array(self.files.offsets)
        shown = np.frombuffer((TERMINATOR + self.alphabet.letters).encode(), np.uint8)

        def made(r: int, places: np.ndarray, own: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.argsort(places)
            places, before = places[order], before[order]
            rows = []
            cuts = np.append(np.searchsorted(places, first), len(places))
            for c in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[c], cuts[c + 1])
                rows.append((int(c), r, int(cuts[c + 1] - cuts[c]), _gaps(places[part] - first[c]), pa.compress(before[part].tobytes(), codec="zstd", asbytes=True), None))
            yield from _table(rows).to_batches()

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = {}
            for batch in batches:
                for m in batch.to_pylist():
                    c, n = m["chunk"], m["n"]
                    text = texts.setdefault(c, np.zeros(files.sizes[c] + 1, np.uint8))  # a letter stands at the place of its row
                    text[_places(m["a"], n)] = shown[np.frombuffer(pa.decompress(m["b"], n, codec="zstd", asbytes=True), np.uint8)]
            for c, text in texts.items():
                start = files.load("start.npy")
                lo, hi = np.searchsorted(start, [first[c], first[c] + files.sizes[c]])
                own, size, srank = start[lo:hi] - first[c], files.load("size.npy")[lo:hi], files.load("srank.npy")[lo:hi]
                for i in range(0, hi - lo, 1000):
                    part = slice(i, min(i + 1000, hi - lo))
                    s = [text[a + 1 : a + 1 + n].tobytes().decode() for a, n in zip(own[part].tolist(), size[part].tolist(), strict=True)]
                    yield pa.record_batch([pa.array(srank[part]), pa.array(s, pa.string())], ["srank", "s"])

        chunks = len(files.offsets)
        return self._sorted(made, _ROWS).repartition(chunks, "chunk").mapInArrow(join, "srank bigint, s string")
