"""Whole tasks with one call each: build an index, inspect it, search, mine repeats, predict, edit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, Alphabet
from ..operators import edit as editing
from ..operators import predict as prediction
from ..operators import repeats as mining
from ..operators import suffix
from ..operators.ranking import kept
from ..sources.fasta import fasta_lines
from .index import SequenceIndex


def build(seqs: DataFrame, alphabet: str = "protein", *, revcomp: bool = False, reverse: bool = False, revsort: bool = False, save: str | None = None) -> SequenceIndex:
    """Index of (sid, name, s, strand); ``reverse`` reads backwards, ``revcomp`` adds the other strand,
    ``revsort`` orders terminators by the reversed texts."""
    index = SequenceIndex.build(seqs, Alphabet.of(alphabet), revcomp=revcomp, reverse=reverse, revsort=revsort)
    if save:
        index.save(save)
    return index


def inspect_word(index: SequenceIndex, word: str) -> tuple[int, int]:
    """First row and number of rows that start with the word; (0, 0) if none do."""
    spark = index.sa.sparkSession
    words = spark.createDataFrame([(word,)], "word string").select(index.alphabet.clean(F.col("word")).alias("word"))
    r = index.lookup(words).first()
    return (r["lo"], r["width"]) if r else (0, 0)


def inspect_rows(index: SequenceIndex, start: int, length: int, up: int = 0, down: int = 0, form: str = "b10i10l10 p5 B s30") -> DataFrame:
    return suffix.row_dump(index.sa, index.seqs, start, length, up, down, form)


def inspect_word_rows(index: SequenceIndex, word: str, up: int = 0, down: int = 0, form: str = "b10i10l10 p5 B s30") -> DataFrame:
    lo, width = inspect_word(index, word)
    return inspect_rows(index, lo, width, up, down, form) if width else inspect_rows(index, 0, 0, 0, 0, form)


def inspect_names(index: SequenceIndex) -> DataFrame:
    """(srank, signed_length, terminator_row, name)."""
    n = (F.length("s") * F.col("strand")).cast("bigint")
    return index.seqs.select("srank", n.alias("signed_length"), F.col("term_order").alias("terminator_row"), "name")


def inspect_sequences(index: SequenceIndex, width: int = 70) -> DataFrame:
    """(value): all sequences, rebuilt from the index alone, as wrapped records (one line each if width < 0)."""
    texts = suffix.reconstruct(index.sa).join(index.seqs.select("srank", "name"), "srank")
    return fasta_lines(texts, width)


def inspect_forward(index: SequenceIndex, row: int, limit: int = 500) -> str | None:
    """Text from a row onwards, with the terminator where it ends."""
    found = suffix.forward_walk(index.sa.where(F.col("row") == row), index.seqs, limit).first()
    return found["text"] if found else None


def find(index: SequenceIndex, queries: DataFrame, min_len: int = 5, max_match: int = 0, *, compat: bool = False, lines: bool = False) -> DataFrame:
    """Maximal matches (qid, qi, ql, lo, width) of query texts (sid, s), or their printed lines."""
    if not lines:
        return index.max_matches(queries, min_len, max_match, compat)
    return index.hit_lines(queries, min_len, max_match, compat)


def mine_repeats(index: SequenceIndex, *, minlen: int = 25, maxlen: int = 45, min_interval: int = 10, maxfrac: float = 0.8, printall: bool = False) -> DataFrame:
    """Frequent words with diverse neighbours of an index of both strands."""
    if not index.revcomp:
        raise ValueError("repeats need an index of both strands")
    return mining.exact_repeats(index.seqs, index.alphabet, minlen, maxlen, min_interval, maxfrac, printall)


def predict(corpus: DataFrame, seqs: DataFrame | None = None, *, kmax: int = 3, kmin: int = 2, alpha: float = 100.0, markov: bool = False, both: bool = False, subtract: bool | None = None, name: str | None = None) -> DataFrame:
    """Sites of ``seqs`` given the words of ``corpus``. Without ``seqs`` the corpus itself is scanned
    and every site left out of its own counts; with them nothing is left out unless ``subtract``."""
    model = prediction.Model(kmin, kmax, alpha, markov, both, (seqs is None) if subtract is None else subtract)
    scanned = corpus if seqs is None else seqs
    return prediction.site_probabilities(corpus, scanned.where(F.col("name") == name) if name is not None else scanned, model)


def predict_words(sites: DataFrame, length: int) -> DataFrame:
    return prediction.word_table(kept(prediction.word_statistics(sites, length), "words"), length)


def edit(seqs: DataFrame, features: DataFrame | None = None, *, alphabet: Alphabet = DNA, revcomp: bool = False, both: bool = False, translate: bool = False, upper: bool = False, lower: bool = False, split: bool = False, new_char: str | None = None, invert: bool = False, skip: bool = False, replace: str | None = None) -> DataFrame:
    """Whole sequences, or sequences by intervals; options that do not go together are refused."""
    if features is None:
        if new_char or invert:
            raise ValueError("a mask character and inversion need intervals")
        return editing.whole_sequences(seqs, alphabet, revcomp, both, upper, lower, translate)
    if revcomp or both or translate:
        raise ValueError("reverse complements and translation do not go with intervals")
    return editing.edit_intervals(seqs, features, editing.Edit(upper, lower, new_char, replace, invert, split, skip))
