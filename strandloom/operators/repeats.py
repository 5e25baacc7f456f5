"""Frequent words with diverse neighbours (exact repeats).

Both strands are counted from the forward texts: a window and its reverse complement are one. Texts are kept
once, as packed letters. First only a hash of each window is counted, in sorted lists of which the gaps are sent.
Windows that pass a filter of the frequent hashes are then sent as spans: neighbours in the text that are
dealt to the same task share their letters. A task holds all occurrences of its words with the letters in
front of them, sorted from their last letter to the left, so words grow in it level by level without another
exchange: rare words are dropped, words with one dominant left letter go on, the others are recorded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet, six_digits
from .kmers import STEP, spread
from .ranking import forget, kept, numbered, release

BROADCAST_ROWS = 4_000_000  # frequent hashes that have 64 bits each in the filter that is broadcast; more share them
LIST = 1 << 23  # hashes of a sorted list
SPANS = 1 << 22  # letters of the spans that are sent at once
ROWS = 1 << 21  # words with their letters in front that a task holds before equal ones become one
SHARE = 1 << 21  # letters of the texts for each task that grows words
RANGE = 1 << 22  # hashes of a range, all their occurrences
SPARE_BITS = 4  # of a hash, beyond those that number all windows
BLOCK_BITS = 20  # of the filter, sent at once
MINIMIZER = 13  # letters of the part of a window by which it is dealt
ODD = 0x9E3779B97F4A7C15


def _gaps(values: np.ndarray) -> bytes:
    """Sorted numbers as their first and the gaps between them: the low bytes, then the rest, both packed."""
    gaps = np.diff(values, prepend=np.int64(0))
    high = gaps >> 8
    wide = np.flatnonzero(high > 254)
    parts = [(gaps & 255).astype(np.uint8), np.where(high > 254, 255, high).astype(np.uint8), high[wide]]
    return np.array([len(values), len(wide)], np.int64).tobytes() + pa.compress(b"".join(x.tobytes() for x in parts), codec="zstd", asbytes=True)


def _values(packed: bytes) -> np.ndarray:
    n, wide = (int(x) for x in np.frombuffer(packed[:16], np.int64))
    raw = pa.decompress(packed[16:], 2 * n + 8 * wide, codec="zstd", asbytes=True)
    high = np.frombuffer(raw, np.uint8, n, n).astype(np.int64)
    high[high == 255] = np.frombuffer(raw, np.int64, wide, 2 * n)
    return np.cumsum(high << 8 | np.frombuffer(raw, np.uint8, n))


def _column(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).copy()


def frequent_hashes(marks: DataFrame, bits: int, ranges: int, least: int, of: Callable[[pa.RecordBatch], np.ndarray] = _column) -> DataFrame:
    """(mark): the hashes of ``bits`` bits that ``marks`` holds ``least`` times: its first column, or those
    that ``of`` makes of its batches.

    Each task sorts its hashes and sends every range of hashes the gaps of its list: some one and a half bytes
    for a hash, where a row has ten and more.
    """
    bounds = np.array([(r << bits) // ranges for r in range(1, ranges)], np.int64)
    most = LIST

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(held: list[np.ndarray]) -> pa.RecordBatch:
            values = np.concatenate(held)
            held.clear()
            values.sort()
            parts = [(r, _gaps(x)) for r, x in enumerate(np.split(values, np.searchsorted(values, bounds))) if len(x)]
            return pa.record_batch([pa.array([r for r, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["range", "list"])

        held, n = [], 0
        for batch in batches:
            for row in range(0, batch.num_rows, 64):  # a piece of text has many hashes
                held.append(of(batch.slice(row, 64)))
                n += len(held[-1])
                if n >= most:
                    yield lists(held)
                    held, n = [], 0
        if n:
            yield lists(held)

    def count(table: pa.Table) -> pa.Table:
        values = np.concatenate([_values(x.as_buffer()) for x in table["list"]])
        values.sort()
        starts = np.flatnonzero(np.diff(values, prepend=values[0] - 1))
        return pa.table({"mark": values[starts[np.diff(starts, append=len(values)) >= least]]})

    lists = marks.mapInArrow(pack, "range int, list binary")
    return lists.repartition(ranges, "range").groupBy("range").applyInArrow(count, "mark bigint")


def hash_filter(often: DataFrame, bits: int) -> tuple[Broadcast, int]:
    """A bit for each value of the first bits of a hash, set for those of ``often`` (mark), and the bits that are
    left out. Hashes that share their first bits pass together."""
    size = min(bits, max(6, min((64 * BROADCAST_ROWS).bit_length() - 1, often.count().bit_length() + 6)))
    left_out, block = bits - size, min(size, BLOCK_BITS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.unique(_column(batch) >> left_out) for batch in batches]
        places = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        numbers, starts = np.unique(places >> block, return_index=True)
        for b, own in zip(numbers.tolist(), np.split(places, starts[1:])):
            flags = np.zeros(1 << block, np.uint8)
            flags[own - (b << block)] = 1
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([pa.compress(np.packbits(flags, bitorder="little"), codec="zstd", asbytes=True)], pa.binary())], ["block", "flags"])

    out = np.zeros(((1 << size) >> block, (1 << block) >> 3), np.uint8)
    for row in often.mapInArrow(pack, "block int, flags binary").collect():
        out[row["block"]] |= np.frombuffer(pa.decompress(bytes(row["flags"]), out.shape[1], codec="zstd"), np.uint8)
    return often.sparkSession.sparkContext.broadcast(out.ravel()), left_out


def _numbers(x: np.ndarray, k: int, base: int, back: bool = False) -> np.ndarray:
    """For each place the number whose digits are the k values from there on, the first or, ``back``, the
    last of them the most significant."""

    def joined(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
        """n digits at a place and the m behind them."""
        a, b = a[: len(x) - n - m + 1], b[n : len(x) - m + 1]
        power = x.dtype.type(pow(base, n if back else m, 1 << 64))
        return b * power + a if back else a * power + b

    if len(x) < k:
        return x[:0]
    out, done, part, size = None, 0, x, 1
    while size <= k:
        if k & size:
            out, done = (part, size) if out is None else (joined(out, done, part, size), done + size)
        if 2 * size <= k:
            part = joined(part, size, part, size)
        size *= 2
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """x with its bits mixed, in place."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> np.uint64(33)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run behind the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class Miner:
    """The steps of one job in Python workers. Letters are digits from 1, and 0 where a text has none."""

    def __init__(self, alphabet: Alphabet, k: int, context: int, least: int, most: float) -> None:
        self.k, self.context, self.least, self.most = k, context, least, most
        self.letters = alphabet.letters
        self.base = len(alphabet.letters) + 1
        self.twin = np.array([0, *(1 + alphabet.letters.index(c) for c in alphabet.complement_letters)], np.uint8)
        self.minimizer = min(MINIMIZER, k - 3)
        self.step, self.sent, self.rows = STEP, SPANS, ROWS
        #: Digits of a byte, and of the numbers by which words with their letters in front are sorted.
        self.packed = next(n for n in range(8, 0, -1) if self.base**n <= 256)
        per = next(n for n in range(62, 0, -1) if self.base**n < 1 << 63)
        self.widths = [min(per, k + context - at) for at in range(0, k + context, per)]
        self.per = per

    def pack(self, x: np.ndarray) -> bytes:
        x = np.pad(x, (0, -len(x) % self.packed)).reshape(-1, self.packed)
        out = x[:, 0].copy()
        for i in range(1, self.packed):
            out *= np.uint8(self.base)
            out += x[:, i]
        return out.tobytes()

    def unpack(self, data: np.ndarray, n: int) -> np.ndarray:
        powers = self.base ** np.arange(self.packed - 1, -1, -1)
        table = (np.arange(256)[:, None] // powers % self.base).astype(np.uint8)
        return table[data].ravel()[:n]

    def cut(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(n, data): the texts one behind the other with ``context`` places between them, cut into pieces of
        which each has the windows that start at its own STEP places, with ``context`` digits at both sides."""
        digit = np.zeros(256, np.uint8)
        digit[list(self.letters.encode())] = np.arange(1, self.base)
        gap, over = self.context, self.k - 1 + self.context
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            if not len(ends) or ends[-1] == ends[0]:
                continue
            digits = digit[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
            if not digits.all():
                raise ValueError(f"letters other than {self.letters} in a sequence")
            sizes = np.diff(ends)
            tape = np.zeros(len(digits) + gap * (len(sizes) + 1), np.uint8)
            tape[_runs(ends[:-1] - ends[0] + gap * np.arange(1, len(sizes) + 1), sizes)] = digits
            pieces = [tape[at - gap : at + self.step + over] for at in range(gap, len(tape) - over, self.step)]
            yield pa.record_batch([pa.array([len(x) for x in pieces], pa.int32()), pa.array([self.pack(x) for x in pieces], pa.binary())], ["n", "data"])

    def pieces(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for n, data in zip(batch["n"].to_pylist(), batch["data"], strict=True):
            yield self.unpack(np.frombuffer(data.as_buffer(), np.uint8), n)

    def hashes(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place of x a hash of its k letters that their reverse complement has too, and whether
        they are their own."""
        f = _numbers(x.astype(np.uint64), k, ODD)
        r = _numbers(self.twin[x].astype(np.uint64), k, ODD, back=True)
        same = f == r
        return _mixed(np.minimum(f, r)), same

    def whole(self, x: np.ndarray) -> np.ndarray:
        """Whether a piece has k letters at a place, for its own places only."""
        none = np.cumsum(np.concatenate([[0], x == 0]), dtype=np.int32)
        ok = none[self.k :] == none[: len(none) - self.k]
        ok[: self.context] = ok[max(0, len(ok) - self.context) :] = False
        return ok

    def marks(self, bits: int) -> Callable[[pa.RecordBatch], np.ndarray]:
        """Hashes of the windows of pieces; a window that is its own reverse complement stands for two."""

        def of(batch: pa.RecordBatch) -> np.ndarray:
            out = [np.zeros(0, np.int64)]
            for x in self.pieces(batch):
                mark, same = self.hashes(x, self.k)
                mark = (mark >> np.uint64(64 - bits)).view(np.int64)
                ok = self.whole(x)
                out += [mark[ok], mark[ok & same]]
            return np.concatenate(out)

        return of

    def spans(self, shared: Broadcast, bits: int, left_out: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """(part, spans, digits, list): windows that pass the filter, dealt by the least hash of a few of their
        letters, which the reverse complement has too. Neighbours of one such hash are one span."""
        shift, around = np.uint64(64 - bits + left_out), 2 * self.context + self.k - 1

        def found(x: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
            place = (self.hashes(x, self.k)[0] >> shift).view(np.int64)
            at = np.flatnonzero(self.whole(x))
            place = place[at]
            at = at[flags[place >> 3] >> (place & 7).astype(np.uint8) & 1 != 0]
            if not len(at):
                return None
            least, have = self.hashes(x, self.minimizer)[0], 1
            wanted = self.k - self.minimizer + 1
            while have < wanted:
                more = min(have, wanted - have)
                least = np.minimum(least[: len(least) - more], least[more:])
                have += more
            least = least[at]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (least[1:] != least[:-1])]))
            sizes = np.diff(first, append=len(at))
            return x[_runs(at[first] - self.context, sizes + around)], sizes, (least[first] % np.uint64(parts)).astype(np.int64)

        def lists(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            letters, sizes, part = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(part, kind="stable")
            starts = (np.cumsum(sizes + around) - sizes - around)[order]
            sizes, part = sizes[order], part[order]
            letters = letters[_runs(starts, sizes + around)]
            ends = np.cumsum(sizes + around)
            rows = []
            first = np.flatnonzero(np.diff(part, prepend=-1))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
                own = letters[ends[a] - sizes[a] - around : ends[b - 1]]
                rows.append((int(part[a]), b - a, len(own), pa.compress(sizes[a:b].astype(np.int32).tobytes() + self.pack(own), codec="zstd", asbytes=True)))
            columns = list(zip(*rows, strict=True))
            return pa.record_batch([*(pa.array(x, pa.int32()) for x in columns[:3]), pa.array(columns[3], pa.binary())], ["part", "spans", "digits", "list"])

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags = shared.value
            held, n = [], 0
            for batch in batches:
                for x in self.pieces(batch):
                    own = found(x, flags)
                    if own:
                        held.append(own)
                        n += len(own[0])
                    if n >= self.sent:
                        yield lists(held)
                        held, n = [], 0
            if held:
                yield lists(held)

        return send

    def words(self, spans: int, digits: int, data: bytes) -> list[np.ndarray]:
        """Numbers of the windows of a list and of their reverse complements with the letters in front of
        them, from the last letter of a window to the left."""
        raw = pa.decompress(data, 4 * spans + -(-digits // self.packed), codec="zstd", asbytes=True)
        sizes = np.frombuffer(raw, np.int32, spans).astype(np.int64)
        x = self.unpack(np.frombuffer(raw, np.uint8, offset=4 * spans), digits)
        all_ = sizes + 2 * self.context + self.k - 1
        at = _runs(np.cumsum(all_) - all_ + self.context, sizes)
        forward, back = x.astype(np.int64), self.twin[x].astype(np.int64)
        out, first = [], 0
        for width in self.widths:
            f = _numbers(forward, width, self.base, back=True)[at + self.k - first - width]
            out.append(np.concatenate([f, _numbers(back, width, self.base)[at + first]]))
            first += width
        return out

    def digit(self, columns: list[np.ndarray], i: int) -> tuple[int, np.ndarray]:
        """The column that has the digit at place i, and its digits up to that one."""
        c = i // self.per
        return c, columns[c] // self.base ** (self.widths[c] - 1 - (i - c * self.per))

    @staticmethod
    def sorted(held: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Rows in order, equal ones as one with their number."""
        columns = [np.concatenate(x) for x in zip(*(c for c, _ in held), strict=True)]
        n = np.concatenate([n for _, n in held])
        held.clear()
        order = np.lexsort(columns[::-1])
        columns = [x[order] for x in columns]
        first = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in columns])]))
        return [x[first] for x in columns], np.add.reduceat(n[order], first)

    def mine(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, length, nseq, frac) of the recorded words of a task."""
        held, rows, most = [], 0, self.rows
        for batch in batches:
            for spans, digits, data in zip(*(batch[x].to_pylist() for x in ("spans", "digits", "list")), strict=True):
                columns = self.words(spans, digits, data)
                held.append((columns, np.ones(len(columns[0]), np.int64)))
                rows += len(columns[0])
                if rows >= most:
                    held = [self.sorted(held)]
                    rows = len(held[0][1])
                    most = max(self.rows, 2 * rows)
        if held:
            yield from self.levels(*self.sorted(held))

    def levels(self, columns: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for d in range(self.k, self.k + self.context):
            c, upper = self.digit(columns, d - 1)
            new = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in (*columns[:c], upper)])])
            c, upper = self.digit(columns, d)
            left = upper % self.base
            # Rows of a word are sorted by the letter in front of it.
            each = np.flatnonzero(new | np.concatenate([[True], left[1:] != left[:-1]]))
            count = np.add.reduceat(n, each)
            word = np.flatnonzero(new[each])
            width = np.add.reduceat(count, word)
            count[left[each] == 0] = 0
            nseq, top = np.add.reduceat(count, word), np.maximum.reduceat(count, word)
            often = (width >= self.least) & (nseq >= max(1, self.least))
            frac = top / np.maximum(nseq, 1)
            record = np.flatnonzero(often & (frac < self.most))
            starts = np.flatnonzero(new)
            for a in range(0, len(record), STEP):
                own = record[a : a + STEP]
                yield self.recorded([x[starts[own]] for x in columns], d, nseq[own], frac[own])
            going = (often & (frac >= self.most))[np.cumsum(new) - 1] & (left > 0)
            if not going.any():
                break
            columns, n = [x[going] for x in columns], n[going]

    def recorded(self, columns: list[np.ndarray], d: int, nseq: np.ndarray, frac: np.ndarray) -> pa.RecordBatch:
        letters = np.frombuffer(b"*" + self.letters.encode(), np.uint8)
        out = np.empty((len(nseq), d), np.uint8)
        for i in range(d):
            out[:, d - 1 - i] = letters[self.digit(columns, i)[1] % self.base]
        ends = np.arange(len(nseq) + 1, dtype=np.int32) * np.int32(d)
        words = pa.StringArray.from_buffers(len(nseq), pa.py_buffer(ends), pa.py_buffer(out))
        return pa.record_batch([words, pa.array(np.full(len(nseq), d, np.int64)), pa.array(nseq), pa.array(frac)], ["word", "length", "nseq", "frac"])


def repeat_words(seqs: DataFrame, alphabet: Alphabet, minlen: int = 25, maxlen: int = 45, min_interval: int = 10, maxfrac: float = 0.8) -> DataFrame:
    """(word, length, nseq, frac) of recorded words on both strands, kept; rows of ``seqs`` whose strand is -1
    are left out, as the reverse complement of every forward row is counted."""
    if not (10 <= minlen <= 50 and minlen <= maxlen <= 100):
        raise ValueError("10 <= minlen <= 50 and minlen <= maxlen <= 100 are needed")
    spark = seqs.sparkSession
    miner = Miner(alphabet, minlen, maxlen + 2 - minlen, min_interval, maxfrac)
    texts = seqs.where((F.col("strand") > 0) & (F.octet_length("s") > 0)).select("s")
    pieces = kept(spread(texts.mapInArrow(miner.cut, "n int, data binary")), "pieces")
    release(spark)
    # Hashes that meet by chance let more windows through, which are told apart by their words.
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(62, max(32, int(total).bit_length() + SPARE_BITS))
    often = kept(frequent_hashes(pieces, bits, max(1, total // RANGE), min_interval, miner.marks(bits)), "frequent")
    release(spark)
    shared, left_out = hash_filter(often, bits)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARE)
    spans = pieces.mapInArrow(miner.spans(shared, bits, left_out, parts), "part int, spans int, digits int, list binary")
    found = kept(spans.repartitionById(parts, F.col("part")).mapInArrow(miner.mine, "word string, length bigint, nseq bigint, frac double"), "recorded")
    shared.destroy()
    forget(pieces, often)
    return found


def exact_repeats(seqs: DataFrame, alphabet: Alphabet, minlen: int = 25, maxlen: int = 45, min_interval: int = 10, maxfrac: float = 0.8, printall: bool = False) -> DataFrame:
    """(n, word, strand, length, nseq, frac, is_substring): recorded words and their reverse
    complements in sorted order, numbered from 1 as they are printed.

    A row is a substring if the next row starts with its word, or if it is longer than ``maxlen``; these
    are left out unless ``printall``.
    """
    words = repeat_words(seqs, alphabet, minlen, maxlen, min_interval, maxfrac)
    both = words.withColumn("strand", F.lit("+")).unionByName(words.withColumn("word", alphabet.revcomp(F.col("word"))).withColumn("strand", F.lit("-")))
    # Neighbours in sorted order are found over row numbers, not in one task.
    order = ["code", "strand"]
    both = kept(numbered(both.withColumn("code", alphabet.encode(F.col("word"))), order, "at"), "sorted")
    both = both.join(both.select((F.col("at") - 1).alias("at"), F.col("word").alias("next")), "at", "left")
    flagged = F.coalesce(F.col("next").startswith(F.col("word")), F.lit(False)) | (F.col("length") > maxlen)
    both = both.withColumn("is_substring", flagged)
    shown = both if printall else both.where(~F.col("is_substring"))
    return numbered(shown, order, "place").select((F.col("place") + 1).alias("n"), "word", "strand", "length", "nseq", "frac", "is_substring")


def repeat_fasta(repeats: DataFrame, intervals: DataFrame | None = None, prefix: str = "Repeat") -> DataFrame:
    """(n, line): header and word of each repeat; ``intervals`` (word, lo, width) adds the rows of the
    index that start with the word, the end not included."""
    rows = repeats if intervals is None else repeats.join(intervals, "word", "left")
    at = F.lit("") if intervals is None else F.concat(F.lit(" SI="), F.col("lo").cast("string"), F.lit("-"), (F.col("lo") + F.col("width")).cast("string"))
    mark = F.when(F.col("is_substring"), F.lit(" SUBSTRING ")).otherwise(F.lit(""))
    head = F.concat(F.lit(f">{prefix}"), F.col("n").cast("string"), mark, F.lit(" strand="), "strand", at, F.format_string(" length=%d nseq=%d frac=", "length", "nseq"), six_digits(F.col("frac")))
    return rows.select("n", F.concat(head, F.lit("\n"), "word").alias("line"))
