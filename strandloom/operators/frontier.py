"""Visiting words level by level, and tracking or widening their intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, TERMINATOR, Alphabet
from .ranking import kept
from .suffix import extend_backward, initial_intervals

Visit = Callable[[DataFrame, int], DataFrame]


def visit_words(sa: DataFrame, seqs: DataFrame, alphabet: Alphabet, visit: Visit, max_depth: int) -> DataFrame:
    """Union of the frontiers (word, lo, width, depth) that ``visit(frontier, depth)`` lets through.

    ``visit`` gets all words of a depth at once and returns those to go on with; what it leaves out is
    pruned. Levels end with ``max_depth`` or when nothing is left.
    """
    level = initial_intervals(sa, seqs)
    out = None
    for depth in range(1, max_depth + 1):
        level = kept(visit(level, depth).select("word", "lo", "width"), "frontier")
        rows = level.withColumn("depth", F.lit(depth))
        out = rows if out is None else out.unionByName(rows)
        if depth == max_depth or not level.limit(1).count():
            break
        level = extend_backward(sa, level, alphabet)
    return out


def identical_kids(parents: DataFrame, kids: DataFrame) -> DataFrame:
    """(kid, parent): kids whose interval is that of another word of the frontier."""
    own = parents.select(F.col("word").alias("parent"), "lo", "width")
    return kids.select(F.col("word").alias("kid"), "lo", "width").join(own, ["lo", "width"]).where("kid <> parent").select("kid", "parent")


def promote(kids: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Non-empty kids (word, lo, width, ...) in alphabetical order, each interval once: the first word of it."""
    first = F.row_number().over(Window.partitionBy("lo", "width").orderBy(alphabet.encode(F.col("word"))))
    return kids.where("width > 0").withColumn("__first", first).where("__first = 1").drop("__first").orderBy(alphabet.encode(F.col("word")))


PIECE = 1 << 16  # rows of an interval that are one array


def track(sa: DataFrame, tracked: DataFrame) -> DataFrame:
    """(parent, letter, kid_index, index): for every row of each parent interval the place it takes in
    its kid and the parent's index. ``tracked``: (parent, lo, width, index array or null); without an
    array the indices are 0, 1, ...; negative ones count steps since widening and go down by one.

    Row numbers meet the table in an equi-join. A letter's rows of an interval map to neighbouring rows,
    so the place in a kid is the distance to its first; only terminators are numbered by sorting.
    """
    n = F.least(F.lit(PIECE), F.col("width") - F.col("from")).cast("int")
    part = F.when(F.col("index").isNull(), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(None).cast("int"))).otherwise(F.slice("index", (F.col("from") + 1).cast("int"), n))
    rows = tracked.where("width > 0").withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("width") - 1, F.lit(PIECE).cast("bigint"))))
    rows = rows.select("parent", "lo", "from", F.col("index").isNull().alias("plain"), F.posexplode(part).alias("p", "given"))
    at = F.col("from") + F.col("p")
    rows = rows.select("parent", (F.col("lo") + at).alias("row"), F.when(F.col("plain"), at.cast("int")).when(F.col("given") < 0, F.col("given") - 1).otherwise(F.col("given")).alias("index"))
    rows = kept(rows.join(sa.select("row", "bwt", "lf"), "row"), "tracked")
    letters = rows.where(F.col("bwt") != TERMINATOR)
    first = letters.groupBy("parent", "bwt").agg(F.min("lf").alias("first"))
    letters = letters.join(first, ["parent", "bwt"]).select("parent", F.col("bwt").alias("letter"), (F.col("lf") - F.col("first")).cast("int").alias("kid_index"), "index")
    place = F.row_number().over(Window.partitionBy("parent").orderBy("row")) - 1
    ends = rows.where(F.col("bwt") == TERMINATOR).select("parent", F.col("bwt").alias("letter"), place.cast("int").alias("kid_index"), "index")
    return letters.unionByName(ends)


def expand(sa: DataFrame, parents: DataFrame, kids: DataFrame, *, min_len: int, north: int, south: int, frac: float, greedy: bool = False, alphabet: Alphabet = DNA) -> DataFrame:
    """(parent, letter, lo, width, index, grown): kids after widening the majority kid.

    ``parents``: (parent, lo, width); ``kids``: (parent, letter, lo, width, index array). A kid's trusted
    rows have an index >= 0 or <= -min_len; kids without any go. If one letter (the earliest of the
    alphabet among equals) has at least ``frac`` of all trusted rows its kid takes up to ``north`` rows
    before and ``south`` after, as long as the parent's neighbouring BWT letters are that letter; these get
    index -1. ``greedy`` keeps the majority kid only (none without a majority). ``grown`` is -1 without a
    majority.
    """
    trusted = F.size(F.filter("index", lambda x: (x >= 0) | (x <= -min_len)))
    kids = kids.where(F.col("letter") != TERMINATOR).withColumn("t", trusted)
    every = Window.partitionBy("parent")  # one row per letter
    order = Window.partitionBy("parent").orderBy(F.desc("t"), alphabet.encode(F.col("letter")))
    kids = kids.withColumn("sum", F.sum("t").over(every)).withColumn("place", F.row_number().over(order)).where("t > 0")
    wins = (F.col("place") == 1) & (F.col("t") >= frac * F.col("sum"))
    kids = kids.withColumn("wins", wins)
    side = parents.select("parent", F.col("lo").alias("plo"), F.col("width").alias("pwidth")).join(kids.where("wins").select("parent", F.col("letter").alias("top")), "parent")

    def beyond(n: int, up: bool) -> Column:
        """The n rows next to the interval on one side."""
        row = (lambda i: F.col("plo") - i) if up else (lambda i: F.col("plo") + F.col("pwidth") - 1 + i)
        return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.lit(up).alias("up"), i.alias("step"), row(i).alias("row")))

    sides = [beyond(n, up) for n, up in ((north, True), (south, False)) if n > 0]
    if sides:
        near = side.select("parent", "top", F.explode(F.concat(*sides)).alias("x")).select("parent", "top", "x.*")
        near = near.join(sa.select("row", "bwt"), "row").select("parent", "up", "step", (F.col("bwt") == F.col("top")).alias("same"))
        first_other = F.coalesce(F.min(F.when(~F.col("same"), F.col("step"))) - 1, F.max("step"))
        reach = near.groupBy("parent", "up").agg(first_other.alias("reach"))
        reach = reach.groupBy("parent").agg(F.coalesce(F.max(F.when(F.col("up"), F.col("reach"))), F.lit(0)).alias("n"), F.coalesce(F.max(F.when(~F.col("up"), F.col("reach"))), F.lit(0)).alias("s"))
        out = kids.join(reach, "parent", "left")
    else:
        out = kids.withColumn("n", F.lit(0)).withColumn("s", F.lit(0))
    out = out.withColumns({c: F.when(F.col("wins"), F.coalesce(c, F.lit(0))).otherwise(0) for c in ("n", "s")})
    grown = F.max(F.when(F.col("wins"), F.col("n") + F.col("s")).otherwise(-1)).over(every)
    fresh = lambda n: F.array_repeat(F.lit(-1), F.col(n).cast("int"))
    out = out.withColumn("grown", grown)
    out = out.where("wins") if greedy else out
    return out.select("parent", "letter", (F.col("lo") - F.col("n")).alias("lo"), (F.col("width") + F.col("n") + F.col("s")).alias("width"), F.concat(fresh("n"), "index", fresh("s")).alias("index"), "grown")
