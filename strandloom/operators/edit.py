"""Editing sequences by intervals: pieces in and between features, transformed and joined again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, Alphabet, translate_dna


@dataclass(frozen=True)
class Edit:
    """What happens to the features (or, inverted, to what is between them)."""

    upper: bool = False
    lower: bool = False
    new_char: str | None = None
    replace: str | None = None  # "delete" removes
    invert: bool = False
    split: bool = False
    skip: bool = False

    def apply(self, piece: Column) -> Column:
        if self.new_char:
            return F.repeat(F.lit(self.new_char[0]), F.length(piece))
        if self.replace is not None:
            return F.lit("" if self.replace == "delete" else self.replace)
        if self.upper:
            return F.upper(piece)
        return F.lower(piece) if self.lower else piece


def whole_sequences(seqs: DataFrame, alphabet: Alphabet = DNA, revcomp: bool = False, both: bool = False, upper: bool = False, lower: bool = False, translate: bool = False) -> DataFrame:
    """(sid, name, s): sequences forward, as reverse complement (``_revcomp``) or both, translated
    (``_transl``) if asked."""
    out = None
    for back in ([False, True] if both else [revcomp]):
        s = alphabet.revcomp(F.col("s")) if back else F.col("s")
        s = translate_dna(s) if translate else s
        s = F.upper(s) if upper else F.lower(s) if lower else s
        name = F.concat("name", F.lit(("_revcomp" if back else "") + ("_transl" if translate else "")))
        rows = seqs.select("sid", name.alias("name"), s.alias("s"))
        out = rows if out is None else out.unionByName(rows)
    return out


def pieces(seqs: DataFrame, features: DataFrame, skip: bool = False) -> DataFrame:
    """(sid, pieces): for every sequence the array of (ord, is_feature, start, end) of its features and
    what is between them, in order. Only lengths of texts are read.

    ``features``: (name, start, end), half-open from 0; ends beyond the text are cut; overlaps are
    emitted twice and leave nothing between.
    """
    n = F.col("n")
    rows = seqs.select("sid", "name", F.octet_length("s").cast("bigint").alias("n")).join(features, "name", "inner" if skip else "left")
    rows = rows.select("sid", "n", F.least(F.col("start"), n).alias("start"), F.least(F.col("end"), n).alias("end"))
    own = Window.partitionBy("sid").orderBy("start", "end")
    rows = rows.withColumn("last_end", F.coalesce(F.lag("end").over(own), F.lit(0).cast("bigint"))).withColumn("k", F.row_number().over(own)).withColumn("m", F.count("start").over(Window.partitionBy("sid")))
    some = F.col("start").isNotNull()

    def piece(place: Column, is_feature: bool, start: Column, end: Column) -> Column:
        return F.struct(place.alias("ord"), F.lit(is_feature).alias("is_feature"), start.alias("start"), end.alias("end"))

    made = F.array(
        F.when(some, piece(2 * F.col("k"), False, F.col("last_end"), F.col("start"))),
        F.when(some, piece(2 * F.col("k") + 1, True, F.col("start"), F.col("end"))),
        F.when(F.col("k") == F.greatest(F.col("m"), F.lit(1)), piece(2 * F.col("k") + 2, False, F.when(some, F.col("end")).otherwise(F.lit(0).cast("bigint")), n)),
    )
    rows = rows.select("sid", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x"))
    return rows.groupBy("sid").agg(F.array_sort(F.collect_list("x")).alias("pieces"))


def edit_intervals(seqs: DataFrame, features: DataFrame, edit: Edit) -> DataFrame:
    """(sid, name, s): edited sequences; with ``split`` one row for each piece, named
    name_{start + 1}-{end}.

    A sequence's text is joined once to all its pieces and cut as bytes (letters are ASCII), so the work
    is that of the letters and the pieces.
    """
    rows = seqs.select("sid", "name", F.col("s").cast("binary").alias("data")).join(pieces(seqs, features, edit.skip), "sid")

    def target(p: Column) -> Column:
        return ~p["is_feature"] if edit.invert else p["is_feature"]

    def text(p: Column) -> Column:
        own = F.when(p["end"] > p["start"], F.substring("data", (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")).cast("string")).otherwise(F.lit(""))
        return F.when(target(p), edit.apply(own)).otherwise(own)

    if edit.split:
        shown = F.filter("pieces", lambda p: target(p) & (p["end"] > p["start"]) if edit.invert else target(p))
        rows = rows.select("sid", "name", F.explode(F.transform(shown, lambda p: F.struct((p["start"] + 1).alias("first"), p["end"].alias("last"), text(p).alias("s")))).alias("x"))
        return rows.select("sid", F.concat("name", F.lit("_"), F.col("x.first").cast("string"), F.lit("-"), F.col("x.last").cast("string")).alias("name"), "x.s")
    return rows.select("sid", "name", F.array_join(F.transform("pieces", text), "").alias("s"))
