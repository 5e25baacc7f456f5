"""Best-fit packing by linear grouping.

1. Texts become token ids and pieces of at most ``capacity`` tokens (one pass, only lengths kept).
2. The histogram of piece lengths has at most ``capacity`` rows however large the corpus is; the
   whole plan is made from it on the driver. Lengths above ``small`` are cut into groups of equal
   cardinality and rounded up to the largest of their group; patterns (configurations) over these few
   sizes are optimised by column generation; whole multiples of the patterns are used.
3. Actual lengths replace the rounded ones, run by run, so a pattern used a billion times is a few
   runs. What is left and the small pieces then go best-fit into the free space, again by runs.
4. Every piece gets its rank among pieces of its length and finds its run by a bounded broadcast.

Scale: ranks come from windows over (length, bucket) with summed offsets, so a length that a third of
all pieces share is dealt over all buckets.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, stored, worker_memory


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    while n > len(a):
        a = np.concatenate([a, np.zeros_like(a)])
    return a


class ChunkTokens(dict):
    """Ids of a whole text from the ids of its chunks between ASCII white space.

    For tokenizers that lower-case, drop white space, never merge across it and cut between a letter
    or digit and a full stop or comma: encoding chunk by chunk gives the ids of the whole text, and
    every distinct chunk is encoded once. Maps a chunk to its number; ``pool`` holds all ids, ``starts``
    and ``sizes`` where. The first LIMIT chunks, which hold all frequent ones, are remembered; later
    ones are forgotten after each call.
    """

    LIMIT = 400_000
    TAIL = b".,"

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A sign that is one token by itself stands between chunks that are encoded together.
        self.mark, self.mark_id = next((c.encode(), self.encode(c.encode())[0]) for c in "^~|`" if len(self.encode(c.encode())) == 1)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.number = 0
        self.pending: list[bytes] = []
        self.recent: list[bytes] = []
        self.tails: dict[bytes, list[int]] = {}
        self.kept: tuple[int, int] | None = None

    def __missing__(self, chunk: bytes) -> int:
        at = self[chunk] = self.number
        self.number += 1
        self.pending.append(chunk)
        return at

    def encode(self, chunk: bytes) -> list[int]:
        return self.tokenizer.encode_batch_fast([chunk.decode("utf-8", "replace")], add_special_tokens=False)[0].ids

    def keep(self, chunks: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Put the ids of some chunks, one after the other, into the pool."""
        self.pool = _grown(self.pool, self.used + len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[chunks], self.sizes[chunks] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def settle(self) -> None:
        """Encode what is pending: stems together, then stems with a tail of stops and commas."""
        whole = []
        tailed: dict[bytes, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        pending, self.pending = self.pending, []
        for chunk in pending:
            stem = chunk.rstrip(self.TAIL)
            if stem and len(stem) < len(chunk) and (stem[-1:].isalnum() or stem[-1] > 127 and stem.decode("utf-8", "replace").lower()[-1].isalnum()):
                own, stems = tailed[chunk[len(stem) :]]
                own.append(self[chunk])
                stems.append(self[stem])  # a stem not known becomes pending
            else:
                whole.append(chunk)
        self.recent += pending + self.pending
        whole += self.pending
        self.pending = []
        self.starts, self.sizes = _grown(self.starts, self.number), _grown(self.sizes, self.number)
        plain = [c for c in whole if self.mark not in c and b"<|" not in c]
        for i in range(0, len(plain), 256):
            some = plain[i : i + 256]
            ids = np.array(self.encode(b" %s " % self.mark + (b" %s " % self.mark).join(some)), np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            self.keep([self[c] for c in some], ids[ids != self.mark_id], np.diff(np.append(cuts, len(ids))) - 1)
        for chunk in whole:
            if self.mark in chunk or b"<|" in chunk:
                ids = np.array(self.encode(chunk), np.uint32)
                self.keep([self[chunk]], ids, np.array([len(ids)]))
        for tail, (own, stems) in tailed.items():
            if tail not in self.tails:
                self.tails[tail] = self.encode(tail)
            extra = self.tails[tail]
            sizes = self.sizes[stems] + len(extra)
            ends = np.cumsum(sizes)
            ids = self.pool[np.minimum(np.repeat(self.starts[stems] - (ends - sizes), sizes) + np.arange(ends[-1]), len(self.pool) - 1)]
            for j, token in enumerate(extra):
                ids[ends - len(extra) + j] = token
            self.keep(own, ids, sizes)

    def trim(self) -> None:
        if self.kept is not None:
            for chunk in self.recent:
                del self[chunk]
            self.number, self.used = self.kept
        elif self.number > self.LIMIT:
            self.kept = self.number, self.used
        self.recent = []

    def ids(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Token ids of each text."""
        self.trim()
        out = []
        for t in texts:
            # Lower-casing ASCII beforehand changes nothing but the look of special tokens.
            own = (t or b"").split() if t and b"<|" in t else (t or b"").lower().split()
            out.append(np.fromiter(map(self.__getitem__, own), np.int64, len(own)))
        self.settle()
        for i, at in enumerate(out):
            n = self.sizes[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out[i] = self.pool[np.repeat(self.starts[at] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, np.uint32)
        return out


def chunk_tokens(path: str) -> ChunkTokens:
    """One memory per Python worker, kept from task to task."""
    return worker_memory(f"tokens of {path}", lambda: ChunkTokens(path))


def _piece_lengths(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = chunk_tokens(path)
        for batch in batches:
            kind = batch.column(0).type
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                cols: list[list] = [[], [], [], [], [], []]
                for doc, mark, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), tokens.ids(as_bytes(part.column(2))), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        for c, v in zip(cols, (doc, mark, k, start, len(piece), zlib.crc32(piece.tobytes())), strict=True):
                            c.append(v)
                types = (kind, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "mark", "piece", "start", "length", "ids_crc32"])
                del ids, piece, part, cols

    return run


def _best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """Most valuable multiset of sizes within the capacity (unbounded knapsack)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = np.flatnonzero(sizes <= room)
        if len(fits):
            worth = best[room - sizes[fits]] + values[fits]
            j = int(np.argmax(worth))
            if worth[j] > best[room] + 1e-12:
                best[room], last[room] = worth[j], fits[j]
    counts, room = [0] * len(sizes), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns over few sizes with their whole multiplicities: the linear program over all
    configurations, solved by column generation and rounded down."""
    k = len(sizes)
    if not k:
        return []
    columns = [[capacity // s if i == j else 0 for i in range(k)] for j, s in enumerate(sizes)]
    basis = np.array(columns, float).T
    x = np.linalg.solve(basis, np.array(demand, float))
    unit = max(1, capacity // 512)
    coarse = np.array([-(-s // unit) for s in sizes])  # rounded up: any coarse pattern fits
    for _ in range(20 + 4 * k):
        duals = np.linalg.solve(basis.T, np.ones(k))
        value, column = _best_pattern(duals, coarse, capacity // unit)
        if value <= 1 + 1e-9:
            break
        way = np.linalg.solve(basis, np.array(column, float))
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        x = x - ratio[out] * way
        x[out] = ratio[out]
        basis[:, out] = column
    return [([int(v) for v in basis[:, i]], int(np.floor(x[i] + 1e-6))) for i in range(k) if x[i] >= 1]


def plan(histogram: dict[int, int], capacity: int, *, small: int | None = None, groups: int = 24) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, offset) that place every piece.

    The piece of rank r of a run goes to sequence first + r - first rank at the offset. Ranks count
    the pieces of one length from 0.
    """
    small = capacity // 8 if small is None else small
    runs: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    left = dict(histogram)
    next_sequence = 0
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, how many)

    def take(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + n, sequence, offset))
        used[length] += n
        left[length] -= n

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            free[room].append((first, n))

    big = sorted((s for s in left if s > small and left[s]), reverse=True)
    total = sum(left[s] for s in big)
    # Groups of equal cardinality, largest lengths first.
    members: list[list[int]] = []
    count, share = 0, -(-total // groups) if total else 1
    for s in big:
        if not members or count >= share:
            members.append([])
            count = 0
        members[-1].append(s)
        count += left[s]
    sizes = [g[0] for g in members]
    queue = [list(g) for g in members]  # what is left of each group, largest first
    for column, times in configurations(sizes, [sum(left[s] for s in g) for g in members], capacity):
        slots = [g for g, c in enumerate(column) for _ in range(c)]
        while times:
            # As many equal sequences as the current run of every slot allows.
            need: dict[int, int] = defaultdict(int)
            chosen = []
            for g in slots:
                while queue[g] and left[queue[g][0]] <= 0:
                    queue[g].pop(0)
                at = next((s for s in queue[g] if left[s] > need[s]), None)
                if at is not None:
                    need[at] += 1
                    chosen.append(at)
            if not chosen:
                break
            n = min(times, *(left[s] // c for s, c in need.items() if c))
            if not n:
                break
            offset = 0
            for s in chosen:
                take(s, n, next_sequence, offset)
                offset += s
            put(capacity - offset, next_sequence, n)
            next_sequence += n
            times -= n
    # Best fit of everything else, largest first, over rooms kept sorted.
    rooms = sorted(r for r in free if free[r])
    for s in sorted((s for s in left if left[s] > 0), reverse=True):
        while left[s]:
            i = bisect.bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                first, n = free[room].pop()
                fits = min(n, left[s])
                if fits < n:
                    free[room].append((first + fits, n - fits))
                if not free[room]:
                    rooms.pop(i)
                take(s, fits, first, capacity - room)
                rest = room - s
            else:
                fits, first = left[s], next_sequence
                per = capacity // s
                full, extra = divmod(fits, per)
                for k in range(per if full else 0):
                    take(s, full, first, k * s)
                next_sequence += full
                rest, fits = capacity - per * s, full
                if extra:
                    for k in range(extra):
                        take(s, 1, next_sequence, k * s)
                    if capacity - extra * s:
                        if not free[capacity - extra * s]:
                            bisect.insort(rooms, capacity - extra * s)
                        put(capacity - extra * s, next_sequence, 1)
                    next_sequence += 1
            if rest and fits:
                if not free[rest]:
                    bisect.insort(rooms, rest)
                put(rest, first, fits)
    return runs


def sequences(runs: list[tuple[int, int, int, int, int]]) -> int:
    return max((first + hi - lo for _, lo, hi, first, _ in runs), default=0)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 4096, end_id: int = 1, buckets: int = 64, small: int | None = None, groups: int = 24) -> DataFrame:
    """Pack the token pieces of all rows into few sequences of at most ``capacity`` tokens.

    ``tokenizer``: path of a tokenizers file whose tokens never cross ASCII white space. Returns per
    piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset. A row's ids end with
    ``end_id``, so null and empty texts are one piece of one token. Only rows longer than the capacity
    are cut, whole. Repeated rows are packed as often as they occur; pieces of one length are told apart
    by id, text and place, so ties only swap places; null ids are packed like others; columns of other
    names are not read; an empty table gives no sequence.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("binary")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    pieces = stored(rows.mapInArrow(_piece_lengths(tokenizer, capacity, end_id), f"id {kind}, mark bigint, piece int, start bigint, length bigint, ids_crc32 bigint"), "pieces")
    bucket = F.pmod(F.xxhash64("id", "mark", "piece"), F.lit(buckets)).cast("int")
    pieces = pieces.withColumn("bucket", bucket)
    # At most capacity x buckets rows.
    counts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    found = sorted((r[0], r[1], r[2]) for r in counts.collect())
    histogram: dict[int, int] = defaultdict(int)
    before = []
    for length, b, n in found:
        before.append((length, b, histogram[length]))
        histogram[length] += n
    placed = min((plan(histogram, capacity, small=small, groups=g) for g in (groups, 4 * groups)), key=sequences)
    offsets = spark.createDataFrame(before, "length bigint, bucket int, before bigint")
    own = Window.partitionBy("length", "bucket").orderBy("id", "mark", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(own) - 1).join(F.broadcast(offsets), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    by_length: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for length, lo, _, sequence, offset in placed:
        by_length[length].append((lo, sequence - lo, offset))
    # The plan: a bounded number of runs (of the order of capacity x groups).
    table = spark.sparkContext.broadcast({k: tuple(np.array(c, np.int64) for c in zip(*sorted(v), strict=True)) for k, v in by_length.items()})

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        lengths, ranks = (np.asarray(a.to_numpy(zero_copy_only=False)).astype(np.int64) for a in (length, rank))
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for value in np.unique(lengths):
            lo, shift, off = table.value[int(value)]
            here = np.flatnonzero(lengths == value)
            at = np.searchsorted(lo, ranks[here], side="right") - 1
            sequence[here], offset[here] = ranks[here] + shift[at], off[at]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    out = ranked.withColumn("at", place.asNondeterministic()("length", "rank"))
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
