"""Words of fixed length: generation and counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet

STEP = 1 << 15  # letters of a sequence that are cut into windows at a time


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over all tasks. What is made of a row here is many times its size, so a file that few
    tasks read, or one long sequence, must not keep its rows in those tasks."""
    return rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def stretches(seqs: DataFrame, over: int, keep: tuple[str, ...] = ("sid",), *, text: str = "s", before: int = 0, last: Column | None = None) -> DataFrame:
    """(keep..., at, off, data): overlapping stretches of the texts as bytes, one for each STEP positions
    up to ``last`` (the last letter). A stretch holds STEP letters from position ``at``, the ``over``
    letters behind them and the up to ``before`` letters in front; ``off`` is where ``at`` is in data."""
    last = F.octet_length(text) - 1 if last is None else last

    def stretch(a: Column) -> Column:
        b = F.greatest(a - before, F.lit(0))
        return F.struct(a.alias("at"), (a - b).alias("off"), F.substring(F.col(text).cast("binary"), b + 1, a - b + STEP + over).alias("data"))

    rows = seqs.where(last >= 0).select(*keep, F.explode(F.transform(F.sequence(F.lit(0), last, F.lit(STEP)), stretch)).alias("c"))
    return spread(rows.select(*keep, F.col("c.at").alias("at"), F.col("c.off").alias("off"), F.col("c.data").alias("data")))


def windows(seqs: DataFrame, k: int, keep: tuple[str, ...] = ("sid",), *, text: str = "s", before: int = 0, short: bool = False) -> DataFrame:
    """(keep..., pos, word): every window of k letters, pos from 0; with ``before`` also ``left``, the
    up to so many letters in front of it; with ``short`` also the shorter windows at the end.

    Letters are ASCII, so the text is cut as bytes: constant work per window. A long sequence is first
    cut into overlapping stretches of STEP windows, which are dealt over all tasks, so no row and no task
    holds all windows of a sequence.
    """
    rows = stretches(seqs, k - 1, keep, text=text, before=before, last=F.octet_length(text) - (1 if short else k))
    data, off = F.col("data"), F.col("off")
    n = F.least(F.lit(STEP), F.octet_length(data) - off - (0 if short else k - 1))

    # Places are exploded, not words: cutting then runs in generated code and data is not copied.
    rows = rows.where(n > 0).select(*keep, "at", "off", "data", F.explode(F.sequence(F.lit(0), n - 1)).alias("p"))
    i = off + F.col("p")
    word = F.substring(data, i + 1, F.lit(k)).cast("string").alias("word")
    left = F.substring(data, F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before))).cast("string").alias("left")
    return rows.select(*keep, (F.col("at") + F.col("p")).alias("pos"), word, *([left] if before else []))


def acgt(word: Column) -> Column:
    return word.rlike("^[ACGT]+$")


def kmer_counts(seqs: DataFrame, k: int) -> DataFrame:
    """(word, n): occurrences of every word of k letters; partial counts are made before the shuffle."""
    return windows(seqs, k, ()).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def in_reversed_order(counts: DataFrame, alphabet: Alphabet) -> DataFrame:
    """counts (word, n) sorted by the words read backwards, the order of a walk that grows words to the left."""
    return counts.orderBy(F.reverse(alphabet.encode(F.col("word"))))


def both_strand_counts(seqs: DataFrame, k: int, alphabet: Alphabet) -> DataFrame:
    """(word, n): occurrences on both strands; the reverse complements are never made as texts."""
    return with_twins(kmer_counts(seqs, k), alphabet)


def with_twins(counts: DataFrame, alphabet: Alphabet) -> DataFrame:
    """counts (word, n) of one strand as counts of both."""
    twin = counts.select(alphabet.revcomp(F.col("word")).alias("word"), "n")
    return counts.unionByName(twin).groupBy("word").agg(F.sum("n").alias("n"))


def neighbour_histogram(seqs: DataFrame, k: int) -> DataFrame:
    """(word, left_letter, n, tot, top): letters before each word; terminators do not count."""
    grams = windows(seqs, k + 1, ()).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = grams.select(F.substring("word", 2, k).alias("word"), F.substring("word", 1, 1).alias("left_letter"), "n")
    own = Window.partitionBy("word")
    return counts.select("word", "left_letter", "n", F.sum("n").over(own).alias("tot"), F.max("n").over(own).alias("top"))


def nucleotide_kids(seqs: DataFrame, k: int, complement: bool = False) -> DataFrame:
    """(word, n_a, n_c, n_g, n_t): the four letters before each word, complemented if asked."""
    grams = kmer_counts(seqs, k + 1)
    letter = F.substring("word", 1, 1)
    rows = grams.select(F.substring("word", 2, k).alias("word"), (F.translate(letter, "ACGT", "TGCA") if complement else letter).alias("c"), "n")
    return rows.groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("c") == c, F.col("n"))), F.lit(0)).alias(f"n_{c.lower()}") for c in "ACGT"])


def bucket_histogram(seqs: DataFrame, alphabet: Alphabet, prefix: int = 0) -> DataFrame:
    """(bucket, n, start): suffixes by their first letters (shorter near an end), with the first row
    of each bucket after the terminators. One row per bucket: at most letters ** prefix."""
    w = prefix or alphabet.default_prefix()
    if (len(alphabet.letters) + 1) ** w > 1_000_000:
        raise ValueError("more than a million buckets")
    counts = windows(seqs, w, (), short=True).groupBy(F.col("word").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(alphabet.encode(F.col("bucket"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    nseq = seqs.agg(F.count(F.lit(1)).alias("nseq"))
    return counts.withColumn("before", before).crossJoin(F.broadcast(nseq)).select("bucket", "n", (F.col("before") + F.col("nseq")).alias("start"))
