"""Sequence sets: tables (sid BIGINT, name STRING, s STRING, strand TINYINT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet
from .ranking import numbered


def sequences(df: DataFrame, sid: str, text: str | Column, name: str | Column | None = None) -> DataFrame:
    text = F.col(text) if isinstance(text, str) else text
    name = F.col(sid).cast("string") if name is None else F.col(name) if isinstance(name, str) else name
    return df.select(F.col(sid).cast("bigint").alias("sid"), name.alias("name"), text.alias("s"), F.lit(1).cast("tinyint").alias("strand"))


def reversed_set(seqs: DataFrame) -> DataFrame:
    """Every sequence read backwards (no complement)."""
    return seqs.withColumn("s", F.reverse("s"))


def with_revcomp(seqs: DataFrame, alphabet: Alphabet) -> DataFrame:
    """The set and its reverse complements, which come after all forward sequences, same name, strand -1."""
    shift = seqs.agg(F.coalesce(F.max("sid") + 1, F.lit(0)).alias("shift"))
    twin = seqs.crossJoin(F.broadcast(shift)).select((F.col("sid") + F.col("shift")).alias("sid"), "name", alphabet.revcomp(F.col("s")).alias("s"), F.lit(-1).cast("tinyint").alias("strand"))
    return seqs.unionByName(twin)


def corpus_stats(seqs: DataFrame) -> DataFrame:
    """Rows of the index (letters and one terminator per sequence), sequences, longest sequence."""
    n = F.length("s").cast("bigint")
    return seqs.agg(F.coalesce(F.sum(n + 1), F.lit(0)).alias("bwt_len"), F.count(F.lit(1)).alias("nseq"), F.coalesce(F.max(n), F.lit(0)).alias("max_len"))


def sequence_ranks(seqs: DataFrame, alphabet: Alphabet, revsort: bool = False) -> DataFrame:
    """seqs with term_order (read order, or the order of the reversed texts) and srank (order of the
    texts, ties by term_order); both count from 0."""
    enc = alphabet.encode(F.col("s"))
    keyed = seqs.withColumn("__enc", enc)
    first = numbered(keyed.withColumn("__back", F.reverse("__enc")), ["__back", "sid"] if revsort else ["sid"], "term_order")
    return numbered(first, ["__enc", "term_order"], "srank").drop("__enc", "__back")


def sequence_catalogue(seqs: DataFrame, alphabet: Alphabet, revsort: bool = False) -> DataFrame:
    """(srank, signed_length, terminator_row, name): lengths of reverse complements are negative."""
    ranks = sequence_ranks(seqs, alphabet, revsort)
    return ranks.select("srank", (F.length("s") * F.col("strand")).cast("bigint").alias("signed_length"), F.col("term_order").alias("terminator_row"), "name")
