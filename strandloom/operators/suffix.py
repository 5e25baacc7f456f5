"""The suffix table: every suffix in sorted order with its preceding letter and LF row.

Columns: row, sid, srank, pos, bwt, lf. Rows 0 .. nseq - 1 are the terminators in terminator order;
the others are sorted by text with the terminator before every letter and ties by terminator order.

Sorting is prefix doubling: ranks by the first letters, then by pairs of ranks twice as far apart, until
all differ, so texts are never compared letter by letter. Where ranks fit 31 bits and every sequence fits a
task, ranks are packed arrays (``suffix_chunks``); small alphabets need ranks of one place in eight only
(``suffix_files``). Elsewhere each round is one equi-join and one ranking over
distinct pairs of the suffixes still tied, so neither a long sequence nor a long repeat is a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import TERMINATOR, Alphabet
from . import suffix_chunks, suffix_files
from .kmers import STEP, stretches, windows
from .ranking import forget, kept, numbered, ranked, ranked_keys
from .sequences import sequence_ranks

FIRST = 16  # letters in the first key
BLOCK = 1 << 16  # rows between two checkpoints
FEW_WORDS = 1_000_000
FEW_LOOKED_UP = 100_000  # words that are sent to packed ranks
FEW_INTERVALS = 10_000  # intervals whose ends are sent to packed letters


def suffix_ranks(ranks: DataFrame, alphabet: Alphabet, first: int = FIRST) -> DataFrame:
    """(sid, pos, rank): 0-based ranks of all non-empty suffixes. ``ranks``: output of sequence_ranks.

    A rank counts the smaller suffixes, so one that no other suffix shares is final. Only the others take
    part in the next round: it looks up the rank ``h`` letters ahead, which exists, since a suffix that
    ends within ``h`` letters is told apart by its terminator.
    """
    rows = windows(ranks.withColumn("enc", alphabet.encode(F.col("s"))).withColumn("len", F.octet_length("s")), first, ("sid", "term_order", "len"), text="enc", short=True)
    rows = rows.withColumnRenamed("word", "head")
    # A head that reaches the terminator comes before equal heads that go on, by the terminator's order.
    rows = rows.withColumn("end", F.when(F.col("pos") + first >= F.col("len"), F.col("term_order")).otherwise(F.lit(1 << 62)))
    rows = kept(ranked(rows, ["head", "end"], "rank", "same").select("sid", "pos", "rank", "same"), "suffixes")
    final, open_ = rows.where("same = 1"), rows.where("same > 1")
    h = first
    while not open_.isEmpty():
        every = final.unionByName(open_).select("sid", (F.col("pos") - h).alias("pos"), F.col("rank").alias("next")).where("pos >= 0")
        pairs = kept(open_.select("sid", "pos", "rank").join(every, ["sid", "pos"]), "pairs")
        # Places are among the open suffixes; those of one old rank take the ranks from it on.
        places = ranked_keys(pairs, ["rank", "next"], "place")
        starts = places.groupBy("rank").agg(F.min("place").alias("start"))
        new = places.join(starts, "rank").select("rank", "next", (F.col("rank") + F.col("place") - F.col("start")).alias("new"), F.col("__rows").alias("same"))
        rows = kept(pairs.join(new, ["rank", "next"]).select("sid", "pos", F.col("new").alias("rank"), "same"), "suffixes")
        forget(pairs, places)
        final, open_ = final.unionByName(rows.where("same = 1")), rows.where("same > 1")
        h *= 2
    return final.select("sid", F.col("pos").cast("bigint").alias("pos"), "rank")


def suffix_table(seqs: DataFrame, alphabet: Alphabet, revsort: bool = False) -> DataFrame:
    for packed in (suffix_files, suffix_chunks):
        ordered = sequence_ranks(seqs, alphabet, revsort) if revsort else seqs.join(numbered(seqs.select("sid"), ["sid"], "term_order"), "sid")
        ordered = kept(ordered.select("sid", "s", "term_order"), "ordered")
        found = packed.suffix_rows(ordered, alphabet)
        if found is not None:
            return found
        forget(ordered)
    return joined_table(seqs, alphabet, revsort)


def joined_table(seqs: DataFrame, alphabet: Alphabet, revsort: bool = False) -> DataFrame:
    """The suffix table by equi-joins, for any number and length of sequences."""
    ranks = kept(sequence_ranks(seqs, alphabet, revsort), "ranks")
    order = suffix_ranks(ranks, alphabet)
    nseq = ranks.agg(F.count(F.lit(1)).alias("nseq"))
    sized = ranks.withColumn("len", F.octet_length("s"))
    inner = windows(sized, 1, ("sid", "srank", "len")).select("sid", "srank", (F.col("pos") + 1).alias("pos"), "len", F.col("word").alias("bwt")).where("pos < len").drop("len")
    heads = ranks.where("s <> ''").select("sid", "srank", F.lit(0).alias("pos"), F.lit(TERMINATOR).alias("bwt"))
    letters = inner.unionByName(heads)
    body = order.join(letters, ["sid", "pos"]).crossJoin(F.broadcast(nseq)).select((F.col("rank") + F.col("nseq")).alias("row"), "sid", "srank", "pos", "bwt")
    ends = ranks.select(F.col("term_order").alias("row"), "sid", "srank", F.length("s").cast("bigint").alias("pos"), F.when(F.col("s") == "", F.lit(TERMINATOR)).otherwise(F.substring("s", -1, 1)).alias("bwt"))
    return with_lf(kept(ends.unionByName(body), "rows"), alphabet)


def letter_starts(rows: DataFrame, alphabet: Alphabet) -> DataFrame:
    """(bwt, c): first row of the suffixes that start with each letter, and of the terminators."""
    counts = rows.groupBy("bwt").agg(F.count(F.lit(1)).alias("n"))
    code = F.when(F.col("bwt") == TERMINATOR, F.lit("")).otherwise(alphabet.encode(F.col("bwt")))
    before = F.sum("n").over(Window.orderBy(code).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return counts.select("bwt", before.alias("c"))


def occ_checkpoints(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, bwt, occ): occurrences of each letter in all rows before the block."""
    counts = rows.groupBy(F.floor(F.col("row") / block).alias("block"), "bwt").agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("block").distinct().crossJoin(F.broadcast(counts.select("bwt").distinct()))
    counts = grid.join(counts, ["block", "bwt"], "left")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bwt").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select("block", "bwt", before.alias("occ"))


def with_lf(rows: DataFrame, alphabet: Alphabet, block: int = BLOCK) -> DataFrame:
    """rows (row, sid, srank, pos, bwt) with lf: the row of the suffix one letter longer; for a
    terminator the sequence rank."""
    rows = rows.withColumn("block", F.floor(F.col("row") / block))
    own = F.row_number().over(Window.partitionBy("block", "bwt").orderBy("row")) - 1
    marks = occ_checkpoints(rows, block)
    starts = letter_starts(rows, alphabet)
    rows = rows.withColumn("own", own).join(marks, ["block", "bwt"]).join(F.broadcast(starts), "bwt")
    lf = F.when(F.col("bwt") == TERMINATOR, F.col("srank")).otherwise(F.col("c") + F.col("occ") + F.col("own"))
    return rows.select("row", "sid", "srank", "pos", "bwt", lf.cast("bigint").alias("lf"))


def samples(sa: DataFrame, exponent: int = 5, nseq: int | None = None) -> DataFrame:
    """Every 2 ** exponent-th row after the terminators; ``nseq``: the number of sequences, counted if not given."""
    packed = getattr(sa, "packed", None)
    if isinstance(packed, suffix_files.Packed):
        return packed.rows(["row", "srank", "pos"], every=1 << exponent)
    nseq = sa.select("sid").distinct().count() if nseq is None else nseq
    return sa.where((F.col("row") >= nseq) & (F.col("row") % (1 << exponent) == 0)).select("row", "srank", "pos")


def inverse_lf(sa: DataFrame) -> DataFrame:
    """(row, forward_row): the row of the suffix one letter shorter (psi), by a join of lf with row."""
    packed = getattr(sa, "packed", None)
    if isinstance(packed, suffix_files.Packed):
        return packed.rows(["lf", "row"], letters=True).select(F.col("lf").alias("row"), F.col("row").alias("forward_row"))
    return sa.where(F.col("bwt") != TERMINATOR).select(F.col("lf").alias("row"), F.col("row").alias("forward_row"))


def rank_all(sa: DataFrame, probes: DataFrame, alphabet: Alphabet, block: int = BLOCK) -> DataFrame:
    """(k, bwt, lf): for each row number k of ``probes`` the first row that each letter's suffixes
    before k map to: C[c] + occurrences of c in rows below k.

    Probes and rows of the blocks they are in are sorted together once, with a running count of each
    letter, so the work is that of the rows touched and the probes, however many share a block.
    """
    rows = sa.select("row", "bwt", F.floor(F.col("row") / block).alias("block"))
    starts, marks = letter_starts(rows, alphabet), occ_checkpoints(rows, block)
    top = rows.agg(F.max("block").alias("last"))
    asked = probes.select("k").distinct().crossJoin(F.broadcast(top)).select("k", F.least(F.floor(F.col("k") / block), F.col("last")).alias("block"))
    touched = rows.join(asked.select("block").distinct(), "block", "left_semi")
    # A probe comes before the row of its number.
    both = asked.select("block", F.col("k").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("c"))
    both = both.unionByName(touched.select("block", F.col("row").alias("at"), F.lit(1).alias("kind"), F.col("bwt").alias("c")))
    running = Window.partitionBy("block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = [F.struct(F.lit(c).alias("bwt"), F.count(F.when(F.col("c") == c, 1)).over(running).alias("own")) for c in (TERMINATOR, *alphabet.letters)]
    inside = both.select("block", "at", "kind", F.array(*own).alias("x")).where("kind = 0")
    inside = inside.select(F.col("at").alias("k"), "block", F.explode("x").alias("x")).select("k", "block", "x.bwt", "x.own")
    return inside.join(marks, ["block", "bwt"]).join(F.broadcast(starts), "bwt").select("k", "bwt", (F.col("c") + F.col("occ") + F.col("own")).alias("lf"))


def bwt_rows(sa: DataFrame) -> DataFrame:
    """(row, bwt) of a table, kept for ``extend_backward``; pieces of letters where the table is packed."""
    packed = getattr(sa, "packed", None)
    if not isinstance(packed, suffix_files.Packed):
        return kept(sa.select("row", "bwt"), "index")
    pieces = kept(packed.bwt(), "index")
    rows = packed.bwt_rows(pieces)
    rows.packed, rows.pieces = packed, pieces
    return rows


def extend_backward(sa: DataFrame, intervals: DataFrame, alphabet: Alphabet) -> DataFrame:
    """(word, lo, width): all non-empty words one letter longer to the left of ``intervals`` (word, lo, width)."""
    ends = intervals.select(F.col("lo").alias("k")).union(intervals.select((F.col("lo") + F.col("width")).alias("k")))
    pieces, spark = getattr(sa, "pieces", None), sa.sparkSession
    if pieces is not None and intervals.count() <= FEW_INTERVALS:
        found = sa.packed.ranks(pieces, [r["k"] for r in ends.distinct().collect()])
        at = spark.createDataFrame([(k, c, int(n)) for k, x in found.items() for c, n in zip((TERMINATOR, *alphabet.letters), x, strict=True)], "k bigint, bwt string, lf bigint")
    else:
        at = kept(rank_all(sa, ends, alphabet), "ranks")
    lo = at.select(F.col("k").alias("lo"), "bwt", F.col("lf").alias("new_lo"))
    hi = at.select(F.col("k").alias("hi"), F.col("bwt").alias("c"), F.col("lf").alias("new_hi"))
    out = intervals.withColumn("hi", F.col("lo") + F.col("width")).join(lo, "lo").join(hi, "hi").where("bwt = c and new_hi > new_lo")
    return out.where(F.col("bwt") != TERMINATOR).select(F.concat("bwt", "word").alias("word"), F.col("new_lo").alias("lo"), (F.col("new_hi") - F.col("new_lo")).alias("width"))


def initial_intervals(sa: DataFrame, seqs: DataFrame) -> DataFrame:
    """(word, lo, width) of all one-letter words."""
    return word_intervals(sa, seqs, [1])


def word_intervals(sa: DataFrame, seqs: DataFrame, lengths: list[int]) -> DataFrame:
    """(word, lo, width) of all words of the given lengths: the rows that start with each."""
    packed = getattr(sa, "packed", None)
    out = packed.intervals(lengths) if packed else None
    if out is not None:
        return out
    for k in lengths:
        words = windows(seqs, k).join(sa.select("sid", "pos", "row"), ["sid", "pos"]).groupBy("word").agg(F.min("row").alias("lo"), F.count(F.lit(1)).alias("width"))
        out = words if out is None else out.unionByName(words)
    return out


def lookup(sa: DataFrame, seqs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, lo, width) for each asked word, 0 and 0 for words that do not occur.

    The corpus is read once whatever the lengths of the words; what is collected is their distinct
    lengths, no more than the longest word has letters. Up to FEW_WORDS words are broadcast.
    """
    asked = kept(words.select("word").distinct(), "asked")
    lengths, n = asked.where("word <> ''").agg(F.collect_set(F.length("word")), F.count(F.lit(1))).first()
    if not lengths:
        return asked.select("word", F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("width"))
    packed = getattr(sa, "packed", None)
    if packed and n <= FEW_LOOKED_UP:
        found = packed.intervals(sorted(lengths), [r["word"] for r in asked.where("word <> ''").collect()])
        if found is not None:
            return asked.join(found, "word", "left").select("word", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("width", F.lit(0)).alias("width"))
    every = F.array(*[F.lit(k) for k in sorted(lengths)])
    heads = windows(seqs, max(lengths), short=True)
    heads = heads.select("sid", "pos", F.explode(F.transform(F.filter(every, lambda k: k <= F.octet_length("word")), lambda k: F.substring("word", F.lit(1), k))).alias("word"))
    hits = heads.join(F.broadcast(asked) if n <= FEW_WORDS else asked, "word")
    found = hits.join(sa.select("sid", "pos", "row"), ["sid", "pos"]).groupBy("word").agg(F.min("row").alias("lo"), F.count(F.lit(1)).alias("width"))
    return asked.join(found, "word", "left").select("word", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("width", F.lit(0)).alias("width"))


def reverse_intervals(intervals: DataFrame, alphabet: Alphabet) -> DataFrame:
    """intervals with rlo: where the reverse complement's interval starts (null if it does not occur)."""
    twin = intervals.select(alphabet.revcomp(F.col("word")).alias("word"), F.col("lo").alias("rlo"))
    return intervals.join(twin, "word", "left")


def reconstruct(sa: DataFrame) -> DataFrame:
    """(srank, s): all sequences. Where the table has places, each row's letter stands at the place before
    its own; from bwt and lf alone by pointer jumping.

    Every row points to its LF row; distances to the sequence's start double each round, so the number
    of joins is the logarithm of the longest sequence.
    """
    packed = getattr(sa, "packed", None)
    if isinstance(packed, suffix_files.Packed):
        return packed.reconstruct()
    if "pos" in sa.columns:
        letters = F.array_sort(F.collect_list(F.struct("pos", "bwt")))  # the first is the terminator before the text
        text = F.array_join(F.transform(letters, lambda x: x["bwt"]), "")
        return sa.groupBy("srank").agg(F.substring(text, 2, 1 << 30).alias("s")).select(F.col("srank").cast("bigint").alias("srank"), "s")
    nodes = sa.select("row", "bwt", "lf")
    links = kept(nodes.select("row", F.when(F.col("bwt") == TERMINATOR, F.lit(None).cast("bigint")).otherwise(F.col("lf")).alias("to"), F.when(F.col("bwt") == TERMINATOR, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("d"), F.when(F.col("bwt") == TERMINATOR, F.col("lf")).alias("srank")), "links")
    while links.where("`to` is not null").limit(1).count():
        ahead = links.select(F.col("row").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("srank").alias("srank2"))
        links = kept(links.join(ahead, "to", "left").select("row", F.col("to2").alias("to"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.coalesce("srank", "srank2").alias("srank")), "links")
    # d letters stand before the suffix of this row; its bwt letter is the last of them.
    letters = links.join(nodes.select("row", "bwt"), "row").where(F.col("bwt") != TERMINATOR)
    texts = letters.groupBy("srank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "bwt"))), lambda x: x["bwt"]), "").alias("s"))
    return links.select("srank").distinct().join(texts, "srank", "left").select("srank", F.coalesce("s", F.lit("")).alias("s"))


def forward_walk(sa: DataFrame, seqs: DataFrame, limit: int = 500) -> DataFrame:
    """(row, text): the suffix of each row up to ``limit`` letters, with the terminator where it ends.

    Rows meet stretches of the texts, not whole sequences: the work for a row is ``limit`` letters, and a
    long sequence is many keys.
    """
    needed = seqs.join(sa.select("sid").distinct(), "sid", "left_semi").select("sid", F.concat("s", F.lit(TERMINATOR)).alias("s"))
    cut = stretches(needed, limit - 1).select("sid", F.col("at").cast("bigint").alias("at"), "data")
    rows = sa.select("row", "sid", "pos", (F.col("pos") - F.col("pos") % STEP).cast("bigint").alias("at")).join(cut, ["sid", "at"])
    return rows.select("row", F.substring("data", (F.col("pos") - F.col("at") + 1).cast("int"), F.lit(limit)).cast("string").alias("text"))


def first_letters(sa: DataFrame, seqs: DataFrame) -> DataFrame:
    """(row, letter): the first letter of each row's suffix."""
    return forward_walk(sa, seqs, 1).select("row", F.col("text").alias("letter"))


def bwt_slice(sa: DataFrame, start: int, length: int) -> DataFrame:
    return sa.where(F.col("row").between(start, start + length - 1)).select("row", "bwt")


def terminator_inverse(sa: DataFrame, nseq: int) -> DataFrame:
    """(term_order, srank): the permutation between the two orders of the sequences."""
    return sa.where(F.col("row") < nseq).select(F.col("row").alias("term_order"), "srank")


def row_dump(sa: DataFrame, seqs: DataFrame, start: int, length: int, up: int = 0, down: int = 0, form: str = "b10i10l10 p5 B s30") -> DataFrame:
    """(row, line): rows start - up .. start + length + down - 1 in a small format language.

    Letters with an optional width: b row, i position, l signed length, f LF row (numbers, 10 wide), pN
    the N - 1 letters before the BWT letter (6), B the BWT letter, sN N letters of the suffix (30), n the
    name; other characters stand for themselves. Terminators stand for letters beyond either end.
    """
    import re

    rows = sa.where((F.col("row") >= start - up) & (F.col("row") < start + length + down)).join(seqs.select("sid", "name", "s", "strand"), "sid")
    n = F.length("s")
    parts = []
    for kind, width, other in re.findall(r"([bilfpsBn])(\d*)|(.)", form, re.DOTALL):
        if other:
            parts.append(F.lit(other))
            continue
        w = int(width) if width else {"p": 6, "s": 30}.get(kind, 10)
        if kind in "bilf":
            value = {"b": F.col("row"), "i": F.col("pos"), "l": n * F.col("strand"), "f": F.col("lf")}[kind].cast("string")
            parts.append(F.when(F.length(value) >= w, value).otherwise(F.lpad(value, w, " ")))
        elif kind == "p":
            end = F.when(F.col("row") < F.col("nseq"), n).otherwise(F.col("pos").cast("int"))
            parts.append(F.lpad(F.substring("s", F.greatest(end - w + 1, F.lit(1)), F.least(F.greatest(end - 1, F.lit(0)), F.lit(w - 1))), w - 1, TERMINATOR))
        elif kind == "B":
            parts.append(F.col("bwt"))
        elif kind == "s":
            parts.append(F.rpad(F.substring("s", F.col("pos").cast("int") + 1, F.lit(w)), w, TERMINATOR))
        else:
            parts.append(F.col("name"))
    nseq = seqs.agg(F.count(F.lit(1)).alias("nseq"))
    return rows.crossJoin(F.broadcast(nseq)).select("row", F.concat(*parts).alias("line"))
