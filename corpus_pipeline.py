"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Each is judged on what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import language, line_dedup, mixing, packing, simhash
from strandloom.llm.common import stored, table
from strandloom.llm.queries import small_batches, vocabulary

#: Below this share of the likelihood a text is in none of the learned languages.
MIN_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a recognised language go; the others carry the language found.

    A row goes if it has no text, no letter, or a score under MIN_SCORE. Only the fold that is not held out
    teaches; ties go to the first language; repeated rows share their fate; without labelled rows all go.
    """
    small_batches(spark)
    model = language.fit(docs.where(language.fold() != 0).select("doc_id", "text", "lang"))
    found = language.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, but in the largest id; n_chars is that of the text kept.

    No row goes: a null or empty text is one empty line, so it is the empty text afterwards, as is a text
    that loses all its lines. Repeated rows count as documents; an empty table stays empty.
    """
    small_batches(spark)
    out = line_dedup.dedup_lines(docs).withColumn("text", F.col("kept_text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near group stays, that with the smallest id (null ids last, ties by text).

    Texts are near by wide fingerprints of five-word shingles, from a similarity of about 0.8 on.
    Null and empty texts are one group; of equal rows one stays; an empty table stays empty.
    """
    small_batches(spark)
    return simhash.keep_first(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, up to twice; a null source is a source of its own.

    Rows without words are copied once; equal rows share their copies; an empty table stays empty.
    """
    small_batches(spark)
    return mixing.mixed_rows(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence.

    A null or empty text is one piece of one token; repeated rows are packed as often as they occur; only
    texts longer than a sequence are cut; an empty table has no sequence.
    """
    small_batches(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage's model, rounding or tokenizer can be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
