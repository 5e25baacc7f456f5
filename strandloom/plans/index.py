"""An index of a sequence set: its suffix table with the sequences, saved as Parquet."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet
from ..operators import repeats, search, suffix
from ..operators.ranking import kept
from ..operators.sequences import reversed_set, sequence_ranks, with_revcomp


@dataclass
class SequenceIndex:
    alphabet: Alphabet
    seqs: DataFrame  # sid, name, s, strand, term_order, srank
    sa: DataFrame  # row, sid, srank, pos, bwt, lf
    reverse: bool = False
    revcomp: bool = False

    @classmethod
    def build(cls, seqs: DataFrame, alphabet: Alphabet, *, revcomp: bool = False, reverse: bool = False, revsort: bool = False) -> SequenceIndex:
        seqs = seqs.withColumn("s", alphabet.clean(F.col("s")))
        seqs = reversed_set(seqs) if reverse else seqs
        seqs = with_revcomp(seqs, alphabet) if revcomp else seqs
        seqs = kept(sequence_ranks(seqs, alphabet, revsort), "sequences")
        sa = kept(suffix.suffix_table(seqs.select("sid", "name", "s", "strand"), alphabet, revsort), "index")
        return cls(alphabet, seqs, sa, reverse, revcomp)

    def save(self, path: str, block: int = suffix.BLOCK) -> None:
        """Tables under ``path``; suffix rows are partitioned by blocks of rows, so row ranges prune."""
        meta = {"letters": self.alphabet.letters, "case_sensitive": self.alphabet.case_sensitive, "reverse": self.reverse, "revcomp": self.revcomp, "block": block}
        spark = self.sa.sparkSession
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.parquet(f"{path}/meta")
        self.seqs.write.parquet(f"{path}/sequences")
        blocks = self.sa.withColumn("block", F.floor(F.col("row") / block))
        blocks.repartitionByRange("row").sortWithinPartitions("row").write.partitionBy("block").parquet(f"{path}/rows")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SequenceIndex:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
        alphabet = Alphabet(meta["letters"], meta["case_sensitive"])
        return cls(alphabet, spark.read.parquet(f"{path}/sequences"), spark.read.parquet(f"{path}/rows").drop("block"), meta["reverse"], meta["revcomp"])

    def lookup(self, words: DataFrame) -> DataFrame:
        return suffix.lookup(self.sa, self.seqs, words)

    def _hits(self, queries: DataFrame, min_len: int, max_match: int, compat: bool) -> tuple[DataFrame, DataFrame]:
        """Places of the matches, and (qid, qi, ql, lo, width)."""
        queries = queries.withColumn("s", self.alphabet.clean(F.col("s")))
        hits = kept(search.match_hits(queries, self.seqs, min_len, max_match, compat), "hits")
        rows = hits.join(self.sa.select("sid", F.col("pos").alias("tpos"), "row"), ["sid", "tpos"])
        return hits, rows.groupBy("qid", "qi", "ql").agg(F.min("row").alias("lo"), F.count(F.lit(1)).alias("width"))

    def max_matches(self, queries: DataFrame, min_len: int = 5, max_match: int = 0, compat: bool = False) -> DataFrame:
        """(qid, qi, ql, lo, width): maximal matches with the rows they start at."""
        return self._hits(queries, min_len, max_match, compat)[1]

    def hit_lines(self, queries: DataFrame, min_len: int = 5, max_match: int = 0, compat: bool = False) -> DataFrame:
        """(qid, ord, line): one printed line for each place of each match."""
        hits, matches = self._hits(queries, min_len, max_match, compat)
        return search.hit_lines(hits, self.seqs, matches)

    def repeat_fasta(self, minlen: int = 25, maxlen: int = 45, min_interval: int = 10, maxfrac: float = 0.8, printall: bool = False, prefix: str = "Repeat") -> DataFrame:
        """(n, line): repeats with the rows that start with them, for an index of both strands."""
        if not self.revcomp:
            raise ValueError("repeats need an index of both strands")
        found = kept(repeats.exact_repeats(self.seqs, self.alphabet, minlen, maxlen, min_interval, maxfrac, printall), "repeats")
        return repeats.repeat_fasta(found, self.lookup(found.select("word")), prefix)
