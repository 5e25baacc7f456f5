"""Context-conditioned letter probabilities with interpolation and leave-one-out.

Counts come from words of both strands; probabilities depend only on the window's content, so they are
computed once for every distinct window and joined back to the sites.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, argmax_letter, entropy, six_digits
from .kmers import acgt, windows, with_twins
from .ranking import kept

LETTERS = "ACGT"
FEW_WINDOWS = 1 << 17  # distinct windows that are broadcast, some 150 bytes each


@dataclass(frozen=True)
class Model:
    """Options of a prediction: context orders, weight of the shorter context, kind, leave-one-out."""

    kmin: int = 2
    kmax: int = 3
    alpha: float = 100.0
    markov: bool = False
    both: bool = False
    subtract: bool = True

    def __post_init__(self) -> None:
        if not 1 <= self.kmin <= self.kmax <= 16:
            raise ValueError("1 <= kmin <= kmax <= 16 is needed")
        if self.both and not self.markov:
            raise ValueError("both directions need the Markov model")

    @property
    def window(self) -> int:
        return self.kmax + 1 if self.markov and not self.both else 2 * self.kmax + 1


def word_counts(corpus: DataFrame, size: int) -> DataFrame:
    """(word, n): words of ``size`` letters, and the shorter ones at the ends of sequences."""
    return kept(windows(corpus, size, (), short=True).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")


def contexts(corpus: DataFrame, model: Model, words: DataFrame | None = None) -> dict[int, DataFrame]:
    """{order: (ctx, n_A, n_C, n_G, n_T)}: letters in each context, on both strands.

    The corpus is read once: words of the longest size, and shorter ones at the ends of sequences, are
    counted, and the words of every shorter order are their beginnings. ``words``: counts of words at least
    as long, if there are any.
    """
    sizes = {k: k + 1 if model.markov else 2 * k + 1 for k in range(model.kmin, model.kmax + 1)}
    words = word_counts(corpus, sizes[model.kmax]) if words is None else words
    out = {}
    for k, size in sizes.items():
        own = words.where(F.octet_length("word") >= size).select(F.substring("word", 1, size).alias("word"), "n").where(acgt(F.col("word")))
        own = with_twins(own.groupBy("word").agg(F.sum("n").alias("n")), DNA)
        ctx = F.concat(F.substring("word", 1, k), F.substring("word", k + 2, k))
        own = own.select(ctx.alias("ctx"), F.substring("word", k + 1, 1).alias("c"), "n")
        out[k] = kept(own.groupBy("ctx").agg(*[F.coalesce(F.sum(F.when(F.col("c") == c, F.col("n"))), F.lit(0)).alias(f"n_{c}") for c in LETTERS]), "contexts")
    return out


def _folded(rows: DataFrame, tables: dict[int, DataFrame], model: Model, context: Column, ref: str, subtract: bool, out: str) -> DataFrame:
    """rows with {out}_A .. {out}_T: the fold from kmin to kmax; ``context`` holds kmax letters to the
    left (and as many to the right) of the letter."""
    k_max = model.kmax
    rows = rows.withColumn("__ctx", context)
    for c in LETTERS:
        rows = rows.withColumn(f"{out}_{c}", F.lit(0.0))
    for k in range(model.kmin, k_max + 1):
        part = F.substring("__ctx", k_max - k + 1, k) if model.markov else F.concat(F.substring("__ctx", k_max - k + 1, k), F.substring("__ctx", k_max + 1, k))
        rows = rows.withColumn("ctx", part).join(tables[k], "ctx", "left")
        n = {c: F.coalesce(F.col(f"n_{c}"), F.lit(0)).cast("double") for c in LETTERS}
        total = n["A"] + n["C"] + n["G"] + n["T"]
        less = F.when((total > 0), 1.0).otherwise(0.0) if subtract else F.lit(0.0)
        own = {c: n[c] - F.when(F.col(ref) == c, less).otherwise(0.0) for c in LETTERS}
        weight = F.lit(model.alpha) + total - less
        new = {c: F.when((total > 0) & (weight > 0), (model.alpha * F.col(f"{out}_{c}") + own[c]) / weight).otherwise(F.col(f"{out}_{c}")) for c in LETTERS}
        rows = rows.select(*[x for x in rows.columns if not x.startswith("n_") and x != "ctx" and x not in [f"{out}_{c}" for c in LETTERS]], *[new[c].alias(f"{out}_{c}") for c in LETTERS])
    return rows.drop("__ctx")


def window_probabilities(corpus: DataFrame, words: DataFrame, model: Model, counts: DataFrame | None = None) -> DataFrame:
    """words (word) with ref and p_A .. p_T. ``counts``: as in ``contexts``."""
    k = model.kmax
    tables = contexts(corpus, model, counts)
    rows = words.withColumn("ref", F.substring("word", k + 1, 1))
    left, right = F.substring("word", 1, k), F.substring("word", k + 2, k)
    if not model.both:
        return _folded(rows, tables, model, left if model.markov else F.concat(left, right), "ref", model.subtract, "p")
    rows = rows.withColumn("rref", DNA.complement(F.col("ref")))
    rows = _folded(rows, tables, model, left, "ref", model.subtract, "f")
    rows = _folded(rows, tables, model, DNA.revcomp(right), "rref", model.subtract, "r")
    twin = dict(zip(LETTERS, "TGCA", strict=True))
    return rows.select("word", "ref", *[((F.col(f"f_{c}") + F.col(f"r_{twin[c]}")) / 2).alias(f"p_{c}") for c in LETTERS])


def window_sites(corpus: DataFrame, seqs: DataFrame, model: Model) -> DataFrame:
    """(window, sites, ref, alt, p_A .. p_T, p_ref, entropy): one row for each distinct window of only A, C,
    G and T, with the number of its sites. Sites of a window share all of it, so whatever is made of it is
    made here and sent to the sites at the end. A corpus that is searched itself is counted once for both."""
    counts = word_counts(corpus, model.window) if corpus is seqs else None
    at = word_counts(seqs, model.window) if counts is None else counts
    at = at.where((F.octet_length("word") == model.window) & acgt(F.col("word")))
    probs = window_probabilities(corpus, at.select("word"), model, counts)
    p = [F.col(f"p_{c}") for c in LETTERS]
    own = F.coalesce(*[F.when(F.col("ref") == c, x) for c, x in zip(LETTERS, p, strict=True)])
    rows = at.join(probs, "word")
    return kept(rows.select(F.col("word").alias("window"), F.col("n").alias("sites"), "ref", argmax_letter(p).alias("alt"), *p, own.alias("p_ref"), entropy(p).alias("entropy")), "windows")


def at_sites(seqs: DataFrame, model: Model, table: DataFrame) -> DataFrame:
    """The rows of ``table``, which has one row for each ``window``, at its sites: sid, name and pos, which
    counts from 1, come first. Up to FEW_WINDOWS rows are broadcast, so that no site is sent anywhere."""
    table = kept(table, "windows")
    few = table.count() <= FEW_WINDOWS
    at = windows(seqs, model.window, ("sid", "name"))
    rows = at.withColumnRenamed("word", "window").join(F.broadcast(table) if few else table, "window")
    return rows.select("sid", "name", (F.col("pos") + model.kmax + 1).cast("bigint").alias("pos"), *table.columns)


def site_probabilities(corpus: DataFrame, seqs: DataFrame, model: Model) -> DataFrame:
    """(sid, name, pos, window, ref, alt, p_A .. p_T, p_ref, entropy) of every site whose window has
    only A, C, G and T; pos counts from 1."""
    return at_sites(seqs, model, window_sites(corpus, seqs, model).drop("sites"))


def _vcf_columns() -> dict[str, Column]:
    info = F.concat(F.lit("E="), six_digits(F.col("entropy")), F.lit(";P="), F.concat_ws(",", *[six_digits(F.col(f"p_{c}")) for c in LETTERS]))
    return {"REF": F.col("ref"), "ALT": F.col("alt"), "QUAL": F.col("p_ref"), "FILTER": F.when(F.col("alt") == F.col("ref"), "PASS").otherwise("no"), "INFO": info}


def vcf_rows(sites: DataFrame) -> DataFrame:
    """The columns of a VCF file."""
    return sites.select(F.col("name").alias("CHROM"), F.col("pos").alias("POS"), F.col("window").alias("ID"), *[c.alias(n) for n, c in _vcf_columns().items()])


def vcf_sites(corpus: DataFrame, seqs: DataFrame, model: Model, digits: int | None = None) -> DataFrame:
    """vcf_rows of all sites, written once for each window; QUAL to so many ``digits``, if given."""
    table = window_sites(corpus, seqs, model).select("window", *[c.alias(n) for n, c in _vcf_columns().items()])
    table = table if digits is None else table.withColumn("QUAL", F.round("QUAL", digits))
    sites = at_sites(seqs, model, table)
    return sites.select(F.col("name").alias("CHROM"), F.col("pos").alias("POS"), F.col("window").alias("ID"), *_vcf_columns())


def accuracy(sites: DataFrame, weight: str | None = None) -> DataFrame:
    """(total, correct, fraction) of sites, or of rows that stand for ``weight`` sites each."""
    n = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    total = F.coalesce(F.sum(n), F.lit(0))
    right = F.coalesce(F.sum(F.when(F.col("alt") == F.col("ref"), n)), F.lit(0))
    return sites.agg(total.alias("total"), right.alias("correct"), F.when(total > 0, right / total).otherwise(0.0).alias("fraction"))


def word_statistics(sites: DataFrame, length: int) -> DataFrame:
    """(word, count, prob, logp): for each word of ``length`` reference letters at neighbouring sites the
    number of places, the mean product of their probabilities and its mean log2 (null where a product
    is 0). Gaps and sequence ends break words."""
    own = Window.partitionBy("sid").orderBy("pos")
    rows = sites.withColumn("island", F.col("pos") - F.row_number().over(own))
    run = Window.partitionBy("sid", "island").orderBy("pos").rowsBetween(-(length - 1), 0)
    rows = rows.select(F.collect_list("p_ref").over(run).alias("ps"), F.collect_list("ref").over(run).alias("letters")).where(F.size("ps") == length)
    product = F.aggregate("ps", F.lit(1.0), lambda a, x: a * x)
    rows = rows.select(F.array_join("letters", "").alias("word"), product.alias("p"))
    zero = F.max(F.when(F.col("p") > 0, 0).otherwise(1))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("count"), F.avg("p").alias("prob"), F.when(zero == 0, F.avg(F.log2(F.when(F.col("p") > 0, F.col("p"))))).alias("logp"))


def word_table(stats: DataFrame, length: int) -> DataFrame:
    """(num, word, count, prob, logp) of all 4 ** length words, with zeros for those that do not occur."""
    from ..functions.alphabet import number_word

    every = stats.sparkSession.range(4**length).select(F.col("id").alias("num"), number_word(F.col("id"), LETTERS, length).alias("word"))
    return every.join(stats, "word", "left").select("num", "word", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("prob", F.lit(0.0)).alias("prob"), F.coalesce("logp", F.lit(0.0)).alias("logp"))
