"""Searching a corpus with a stream of query lines.

The corpus is static and a query's answer depends on the query alone, so every micro-batch is a batch
search: no watermark and no state. ``foreachBatch`` makes the windows of the containment filter possible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.alphabet import Alphabet
from ..operators.search import max_matches


def search_stream(lines: DataFrame, corpus: DataFrame, alphabet: Alphabet, sink: Callable[[DataFrame, int], None], *, id_col: str, text_col: str, min_len: int = 5, max_match: int = 0, checkpoint: str | None = None) -> StreamingQuery:
    """Start a stream that hands (qid, qi, ql, width) of each micro-batch to ``sink(df, batch_id)``."""

    def batch(df: DataFrame, batch_id: int) -> None:
        queries = df.select(F.col(id_col).cast("bigint").alias("sid"), alphabet.clean(F.col(text_col)).alias("s"))
        sink(max_matches(queries, corpus, min_len, max_match), batch_id)

    writer = lines.writeStream.foreachBatch(batch).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def seed_stream(lines: DataFrame, corpus: DataFrame, alphabet: Alphabet, *, id_col: str, text_col: str, min_len: int) -> DataFrame:
    """Streaming (qid, qpos, sid, tpos): seeds of the stream that occur in the static corpus."""
    from ..operators.kmers import windows

    queries = lines.select(F.col(id_col).cast("bigint").alias("sid"), alphabet.clean(F.col(text_col)).alias("s"))
    asked = windows(queries, min_len).select(F.col("sid").alias("qid"), F.col("pos").alias("qpos"), "word")
    there = windows(corpus, min_len).select("sid", F.col("pos").alias("tpos"), "word")
    return asked.join(there, "word").select("qid", "qpos", "sid", "tpos")
