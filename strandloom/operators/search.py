"""Exact-match joins of query texts against a corpus, without an index.

Seeds of L letters meet in an equi-join; hits in a row on one diagonal are one exact match; matches
contained in a longer one of the same query go; the rest is top-k by length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kmers import windows


def islands(queries: DataFrame, corpus: DataFrame, seed: int) -> DataFrame:
    """(qid, sid, qi, qe, tpos): maximal runs q[qi:qe) = s[tpos:...) of at least ``seed`` letters."""
    asked = windows(queries, seed).select(F.col("sid").alias("qid"), F.col("pos").alias("qpos"), "word")
    there = windows(corpus, seed).select("sid", F.col("pos").alias("tpos"), "word")
    hits = there.join(asked, "word").select("qid", "sid", "qpos", (F.col("tpos") - F.col("qpos")).alias("d"))
    own = Window.partitionBy("qid", "sid", "d").orderBy("qpos")
    hits = hits.withColumn("grp", F.col("qpos") - F.row_number().over(own))
    runs = hits.groupBy("qid", "sid", "d", "grp").agg(F.min("qpos").alias("qi"), (F.max("qpos") + seed).alias("qe"))
    return runs.select("qid", "sid", F.col("qi").cast("bigint").alias("qi"), F.col("qe").cast("bigint").alias("qe"), (F.col("qi") + F.col("d")).cast("bigint").alias("tpos"))


def uncontained(runs: DataFrame, compat: bool = False) -> DataFrame:
    """(qid, qi, qe, width): distinct query stretches that are in no longer one, with their hits.

    ``compat``: a match that starts at 0 is lost where another starts at 1.
    """
    spans = runs.groupBy("qid", "qi", "qe").agg(F.count(F.lit(1)).alias("width"))
    before = Window.partitionBy("qid").orderBy("qi", F.desc("qe")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reach", F.max("qe").over(before)).where("reach is null or qe > reach").drop("reach")
    if compat:
        one = F.max(F.when(F.col("qi") == 1, 1).otherwise(0)).over(Window.partitionBy("qid"))
        spans = spans.withColumn("one", one).where("not (qi = 0 and one = 1)").drop("one")
    return spans


def max_matches(queries: DataFrame, corpus: DataFrame, min_len: int = 5, max_match: int = 0, compat: bool = False) -> DataFrame:
    """(qid, qi, ql, width): maximal matches; with ``max_match`` > 0 whole groups of equal length,
    longest first, until that many hits are reached."""
    spans = uncontained(islands(queries, corpus, min_len), compat).withColumn("ql", F.col("qe") - F.col("qi"))
    return top_matches(spans, max_match).select("qid", "qi", "ql", "width")


def top_matches(spans: DataFrame, max_match: int) -> DataFrame:
    if max_match <= 0:
        return spans
    longer = Window.partitionBy("qid").orderBy(F.desc("ql")).rangeBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("longer", F.coalesce(F.sum("width").over(longer), F.lit(0))).where(F.col("longer") < max_match).drop("longer")


def match_hits(queries: DataFrame, corpus: DataFrame, min_len: int = 5, max_match: int = 0, compat: bool = False) -> DataFrame:
    """(qid, qi, ql, sid, tpos): every place of every maximal match."""
    runs = islands(queries, corpus, min_len)
    spans = top_matches(uncontained(runs, compat).withColumn("ql", F.col("qe") - F.col("qi")), max_match)
    return runs.join(spans.select("qid", "qi", "qe", "ql"), ["qid", "qi", "qe"]).select("qid", "qi", "ql", "sid", "tpos")


def longest_matches(queries: DataFrame, corpus: DataFrame, min_len: int = 5) -> DataFrame:
    """(qid, qi, ql, width): for each query the matches of its greatest length."""
    spans = uncontained(islands(queries, corpus, min_len)).withColumn("ql", F.col("qe") - F.col("qi"))
    best = F.rank().over(Window.partitionBy("qid").orderBy(F.desc("ql")))
    return spans.withColumn("best", best).where("best = 1").select("qid", "qi", "ql", "width")


def greedy_matches(queries: DataFrame, corpus: DataFrame, min_len: int, jump: int) -> DataFrame:
    """(qid, qi, ql): the longest matches found from query ends that are ``min_len`` - ``jump`` apart,
    where the length in force grows with every longer match. ``jump`` < 0 visits every end.

    The ends depend on what has been found, so each query is walked on its own; what is walked is its
    own short list of matches, not the corpus.
    """
    if jump >= min_len:
        raise ValueError("the walk would not advance: jump must be below min_len")
    if jump < 0:
        return longest_matches(queries, corpus, min_len).select("qid", "qi", "ql")
    import pandas as pd

    spans = uncontained(islands(queries, corpus, min_len)).join(queries.select(F.col("sid").alias("qid"), F.length("s").alias("n")), "qid")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        spans = sorted(zip(rows["qi"], rows["qe"], strict=True))
        length, found, j = min_len, [], int(rows["n"].iloc[0]) - 1
        while j >= length - 1:
            start = min((a for a, b in spans if a <= j < b), default=None)
            got = j - start + 1 if start is not None else 0
            if got >= length:
                if got > length:
                    found, length = [], got
                found.append((start, got))
            j -= length - jump
        return pd.DataFrame({"qid": rows["qid"].iloc[0], "qi": [a for a, _ in found], "ql": [b for _, b in found]}).astype("int64")

    return spans.groupBy("qid").applyInPandas(walk, "qid bigint, qi bigint, ql bigint")


def hit_lines(hits: DataFrame, corpus: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(qid, ord, line): one printed line for each hit, longest matches first. ``starts`` (qid, qi, ql, lo)
    gives the first row of each match in an index; without an index there is no such row to print."""
    rows = hits.join(corpus.select("sid", "name"), "sid")
    rows = rows if starts is None else rows.join(starts.select("qid", "qi", "ql", "lo"), ["qid", "qi", "ql"])
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("ql"), "qi", "sid", "tpos"))
    line = F.format_string("%s pos:%d qi:%d ql:%d", "name", "tpos", "qi", "ql") if starts is None else F.format_string("%s pos:%d start:%d qi:%d ql:%d", "name", "tpos", "lo", "qi", "ql")
    return rows.select("qid", order.alias("ord"), line.alias("line"))
