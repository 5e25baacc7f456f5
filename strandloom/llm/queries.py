"""The queries op1 to op10: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, line_dedup, mixing, packing, secrets, simhash, substring, tokens, topk, winnow
from .common import table

#: Rows of an Arrow batch. The queries and the pipeline run two Python workers beside a JVM in 3 GB; the
#: operators take batches of any size and leave the session as it is.
BATCH_ROWS = "2000"


def whole(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table, in a session with small batches."""
    small_batches(spark)
    return table(spark, sf_dir, name)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, as installed on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(whole(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = whole(spark, sf_dir, "documents")
    model = language.fit(docs.where(language.fold() != 0).select("doc_id", "text", "lang"))
    held_out = F.coalesce(language.fold() == 0, F.lit(False)).alias("held_out")
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(whole(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(whole(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnow.beside_next(whole(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(whole(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(whole(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(whole(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(whole(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_language_id, op3_line_dedup, op4_simhash, op5_fingerprints, op6_token_counts, op7_packing, op8_secrets, op9_mixing, op10_topk)
}
