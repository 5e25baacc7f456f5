"""FASTA, query lines and intervals as DataFrames; FASTA also as a Python data source.

Files are split at record starts by the text reader, so one file is read by many tasks; a record is one
row and must fit in a task.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.alphabet import Alphabet, six_digits
from ..operators.ranking import numbered


def parse_fasta(records: DataFrame, alphabet: Alphabet, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., name, s) from rows (value) that hold one record each without its leading ``>``."""
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace("value", r"^[^\r\n]*\r?\n?", "")
    return records.select(*keep, F.regexp_extract(head, r"^([^ ]*)", 1).alias("name"), alphabet.clean(body).alias("s"))


def read_fasta(spark: SparkSession, path: str, alphabet: Alphabet) -> DataFrame:
    """(sid, name, s, strand) in the order of the files. Text before the first record is skipped; ``>``
    starts a record only after a newline; a name ends at the first blank."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = F.row_number().over(Window.partitionBy("file").orderBy("block", "at")) == 1
    # The first piece of a file is a record only if the file starts with one.
    rows = rows.withColumn("first", first).where(~F.col("first") | F.col("value").startswith(">"))
    rows = rows.withColumn("value", F.when(F.col("first"), F.expr("substring(value, 2)")).otherwise(F.col("value")))
    rows = numbered(rows, ["file", "block", "at"], "sid")
    parsed = parse_fasta(rows, alphabet, ("sid",))
    return parsed.withColumn("strand", F.lit(1).cast("tinyint"))


def read_queries(spark: SparkSession, path: str, alphabet: Alphabet) -> DataFrame:
    """(sid, name, s, strand): one query per line, of any length."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = numbered(rows, ["file", "block", "at"], "sid")
    return rows.select("sid", F.col("sid").cast("string").alias("name"), alphabet.clean(F.col("value")).alias("s"), F.lit(1).cast("tinyint").alias("strand"))


def parse_intervals(lines: DataFrame, one_based: bool = False) -> DataFrame:
    """(name, start, end) from rows (value) of TAB-separated text; lines that start with ``#`` or white
    space are skipped; ``one_based`` intervals include both ends."""
    parts = F.split("value", "\t")
    rows = lines.where(~F.col("value").rlike(r"^[#\s]") & (F.col("value") != "")).select(F.get(parts, 0).alias("name"), F.get(parts, 1).cast("bigint").alias("start"), F.get(parts, 2).cast("bigint").alias("end"))
    return rows.withColumn("start", F.col("start") - 1) if one_based else rows


def read_intervals(spark: SparkSession, path: str, one_based: bool = False) -> DataFrame:
    return parse_intervals(spark.read.text(path), one_based)


def fasta_lines(seqs: DataFrame, width: int = 70) -> DataFrame:
    """(value): records as text, wrapped at ``width`` letters; below 0 one line ``name text``."""
    if width < 0:
        return seqs.select(F.concat_ws(" ", "name", "s").alias("value"))
    body = F.regexp_replace("s", rf"(.{{{width}}})(?=.)", "$1\n") if width else F.col("s")
    return seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), body).alias("value"))


def write_fasta(seqs: DataFrame, path: str, width: int = 70) -> None:
    ordered = seqs.repartitionByRange("sid").sortWithinPartitions("sid") if "sid" in seqs.columns else seqs
    fasta_lines(ordered, width).write.text(path)


VCF_HEADER = "##fileformat=VCFv4.3\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"


def vcf_line() -> Column:
    return F.concat_ws("\t", "CHROM", F.col("POS").cast("string"), "ID", "REF", "ALT", six_digits(F.col("QUAL")), "FILTER", "INFO")


def vcf_lines(rows: DataFrame) -> DataFrame:
    """(value): one line per site, without the header."""
    return rows.select(vcf_line().alias("value"))


def write_vcf(rows: DataFrame, path: str) -> None:
    """Text files under ``path`` in the order of sites. The header is the first line of the first file, so
    the files one after the other are one VCF file."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, "", 0, VCF_HEADER)], "kind int, CHROM string, POS bigint, value string")
    lines = head.unionByName(rows.select(F.lit(1).alias("kind"), "CHROM", "POS", vcf_line().alias("value")))
    keys = ["kind", "CHROM", "POS"]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("value").write.text(path)


class FastaSource(DataSource):
    """``spark.read.format("fasta").option("path", ...)``: (name, s); with option
    ``pushdown`` filters on the name are applied while reading.

    Files are read in parts of about ``split`` bytes (64 MB); a record belongs to the part in which its
    ``>`` stands. Writing is append or overwrite: every task writes a hidden file, which is renamed when
    all tasks are done and removed if one fails, so a task that runs twice leaves one file. For paths that
    all executors can open as files; ``read_fasta`` reads any path that Spark reads.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "name string, s string"

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = FastaPushReader if self.options.get("pushdown", "false") == "true" else FastaReader
        return kind(self.options["path"], Alphabet.of(self.options.get("alphabet", "DNA/wildcard")), int(self.options.get("split", 1 << 26)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FastaWriter(self.options["path"], int(self.options.get("width", "70")), overwrite)


def _files(path: str) -> list[str]:
    found = sorted(os.path.join(path, x) for x in os.listdir(path)) if os.path.isdir(path) else [path]
    return [p for p in found if os.path.isfile(p) and not os.path.basename(p).startswith(("_", "."))]


@dataclass
class FilePart(InputPartition):
    path: str
    begin: int
    end: int


class FastaReader(DataSourceReader):
    def __init__(self, path: str, alphabet: Alphabet, split: int) -> None:
        self.path, self.alphabet, self.split, self.names = path, alphabet, split, None

    def partitions(self) -> list[InputPartition]:
        return [FilePart(p, a, a + self.split) for p in _files(self.path) for a in range(0, os.path.getsize(p), self.split)]

    def read(self, partition: FilePart) -> Iterator[tuple[str, str]]:
        letters = set(self.alphabet.letters)
        case, last = self.alphabet.case_sensitive, self.alphabet.letters[-1]

        def cleaned(lines: list[str]) -> str:
            text = "".join(lines)
            text = text if case else text.upper()
            return "".join(c if c in letters else last for c in text if c.isascii() and c.isalpha() or c in letters)

        name, lines = None, []
        with open(partition.path, "rb") as file:
            at = partition.begin
            if at:
                # The line that the part begins in belongs to the part before, unless it begins here.
                file.seek(at - 1)
                at += len(file.readline()) - 1
            for line in file:
                if line.startswith(b">"):
                    if name is not None and (self.names is None or name in self.names):
                        yield name, cleaned(lines)
                    name, lines = None, []
                    if at >= partition.end:
                        return
                    name = line[1:].decode("utf-8", "replace").rstrip("\r\n").split(" ")[0]
                elif name is not None:
                    lines.append(line.decode("utf-8", "replace"))
                elif at >= partition.end:
                    return
                at += len(line)
        if name is not None and (self.names is None or name in self.names):
            yield name, cleaned(lines)


class FastaPushReader(FastaReader):
    """With filters on the name; needs spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters):  # noqa: N802
        from pyspark.sql.datasource import EqualTo, In

        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.names = {f.value} if self.names is None else self.names & {f.value}
            elif isinstance(f, In) and f.attribute == ("name",):
                self.names = set(f.value) if self.names is None else self.names & set(f.value)
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    file: str


class FastaWriter(DataSourceWriter):
    def __init__(self, path: str, width: int, overwrite: bool) -> None:
        self.path, self.width, self.overwrite, self.job = path, width, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        name = f".{self.job}-{uuid.uuid4().hex}"
        with open(os.path.join(self.path, name), "w", encoding="utf-8") as file:
            for row in iterator:
                file.write(f">{row.name}\n")
                step = self.width if self.width > 0 else max(1, len(row.s))
                for i in range(0, len(row.s), step):
                    file.write(row.s[i : i + step] + "\n")
        return Written(name)

    def commit(self, messages) -> None:
        done = [m.file for m in messages if m is not None]
        if self.overwrite:
            for old in _files(self.path) if os.path.isdir(self.path) else []:
                os.remove(old)
        for i, name in enumerate(done):
            os.replace(os.path.join(self.path, name), os.path.join(self.path, f"part-{i:05d}-{self.job}.fa"))
        self._clean()

    def abort(self, messages) -> None:
        self._clean()

    def _clean(self) -> None:
        """Remove hidden files that attempts of this job have left."""
        if os.path.isdir(self.path):
            for x in os.listdir(self.path):
                if x.startswith(f".{self.job}-"):
                    os.remove(os.path.join(self.path, x))
