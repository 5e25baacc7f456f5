"""Document fingerprints by winnowing; DataFrame functions only.

Units are words; texts of fewer than ``short`` bytes and texts whose words have more than ``sparse`` bytes
on average (writing without blanks) also have their UTF-8 bytes as units, so that they keep several hashes.
The hash of a run of k units is a rolling one (a cyclic polynomial: the units' hashes, each rotated by its
distance from the run's end, combined by exclusive or). Runs roll in steps that double: the hash of 2 n
units is that of the first n, rotated by n, with that of the next n, so no unit is read again for the next
run and the work for a run is the logarithm of k. In every window of w neighbouring hashes the smallest is
chosen, the rightmost of equals, again from windows of half the length.

Two texts that share ``w + k - 1`` words in a row share a chosen hash (the match guarantee), and if both
have bytes as units, ``w + byte_k - 1`` bytes are enough. The position of every chosen hash is kept: the
first word of the run, or after ``b`` its first byte. A text of fewer than k units has the hash of all of
them, one of fewer than w hashes has its smallest one.

Scale: a fingerprint is a projection of its row, with work linear in the text. The neighbour in id order
comes from windows over ranges of ids cut at quantiles; only the first row of each range is copied to the
range before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most ranges of ids.
RANGES = 1 << 13


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once, though a lambda inside refers to it again and again."""
    return F.get(F.transform(F.array(value), use), 0)


def _beside(a: Column, shift: int, f) -> Column:
    """f of each element and the one ``shift`` places behind it."""
    n = F.size(a) - shift
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(shift + 1), n), f)


def _turned(x: Column, by: int) -> Column:
    by %= 64
    return x if not by else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _doubled(units: Column, n: int, join) -> Column:
    """``join(a, b, length)`` over every run of ``n`` neighbouring units, from runs of half the length: b is
    the run of ``length`` units that follows a. ``units`` must have at least n elements."""
    bits = bin(n)[3:]

    def grow(runs: Column, length: int, rest: str) -> Column:
        if not rest:
            return runs
        twice = _beside(runs, length, lambda a, b: join(a, b, length))
        if rest[0] == "0":
            return _bound(twice, lambda t: grow(t, 2 * length, rest[1:]))
        return _bound(twice, lambda t: _bound(F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(units, F.lit(2 * length + 1), F.size(t) - 1), lambda a, b: join(a, b, 1)), lambda u: grow(u, 2 * length + 1, rest[1:])))

    return grow(units, 1, bits)


def rolled(units: Column, k: int) -> Column:
    """array<bigint>: hash of each run of k unit hashes; of all of them where there are fewer."""
    some = F.aggregate(units, F.lit(0).cast("bigint"), lambda acc, x: _turned(acc, 1).bitwiseXOR(x))
    every = _doubled(units, k, lambda a, b, n: _turned(a, n).bitwiseXOR(b))
    return F.when(F.size(units) >= k, every).when(F.size(units) > 0, F.array(some)).otherwise(F.array().cast("array<bigint>"))


def places(hashes: Column, w: int) -> Column:
    """array<int>: positions of the smallest hash of each window of w, the rightmost of equals, each once."""
    least = lambda a, b: F.when(F.get(hashes, b) <= F.get(hashes, a), b).otherwise(a)
    at = F.sequence(F.lit(0), F.size(hashes) - 1)
    every = _bound(at, lambda p: _doubled(p, w, lambda a, b, _: least(a, b)))
    one = F.array(F.aggregate(at, F.lit(0), least))
    return F.when(F.size(hashes) >= w, F.array_distinct(every)).when(F.size(hashes) > 0, one).otherwise(F.array().cast("array<int>"))


def _chosen(units: Column, k: int, w: int) -> Column:
    def pick(hashes: Column) -> Column:
        return F.transform(places(hashes, w), lambda p: F.struct(F.get(hashes, p).alias("hash"), p.alias("at")))

    return _bound(units, lambda u: _bound(rolled(u, k), pick))


def winnowed(text: Column, k: int = 5, w: int = 12, byte_k: int = 8, short: int = 600, sparse: int = 40) -> Column:
    """struct(words, bytes), each array<struct(hash bigint, at int)>: chosen hashes in order."""

    def both(words: Column, data: Column) -> Column:
        units = F.transform(words, lambda x: F.xxhash64(x))
        n = F.octet_length(data)
        single = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.substring(data, i, F.lit(1))))
        fine = (n > 0) & ((n < short) | (F.size(words) * sparse < n))
        return F.struct(_chosen(units, k, w).alias("words"), F.when(fine, _chosen(single, byte_k, w)).otherwise(F.array().cast("array<struct<hash:bigint,at:int>>")).alias("bytes"))

    text = F.coalesce(text, F.lit(""))
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return _bound(F.struct(split.alias("w"), text.cast("binary").alias("d")), lambda x: both(x["w"], x["d"]))


def hash_set(chosen: Column) -> Column:
    """The hashes without their places; those of bytes are told from those of words by their lowest bit."""
    words = F.transform(chosen["words"], lambda x: x["hash"].bitwiseAND(F.lit(-2)))
    single = F.transform(chosen["bytes"], lambda x: x["hash"].bitwiseOR(F.lit(1)))
    return F.array_distinct(F.concat(words, single))


def as_text(chosen: Column) -> Column:
    """hash@position entries, comma-joined, those of bytes as hash@bposition."""

    def entries(part: Column, mark: str) -> Column:
        return F.transform(part, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit(mark), x["at"].cast("string")))

    return F.array_join(F.concat(entries(chosen["words"], "@"), entries(chosen["bytes"], "@b")), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of the hash sets of two fingerprints; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(F.lit(1.0))


def fingerprints(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``fingerprint`` (string; a column so named is replaced); options are those of
    ``winnowed``. Null and empty texts have the empty fingerprint; equal texts have equal ones."""
    return docs.withColumn("fingerprint", as_text(winnowed(F.col(text_col), **options)))


def _upto(bounds: Column, n: int, inside) -> Column:
    """How many of the ``n`` sorted bounds satisfy ``inside``, which holds for a first part of them."""
    steps = []
    while n >> len(steps):
        steps.insert(0, 1 << len(steps))
    return F.aggregate(F.array(*[F.lit(s) for s in steps]) if steps else F.array().cast("array<int>"), F.lit(0), lambda acc, s: F.when((acc + s <= n) & F.coalesce(inside(F.get(bounds, acc + s - 1)), F.lit(False)), acc + s).otherwise(acc))


def _ranged(docs: DataFrame, rows_per_range: int) -> DataFrame:
    """docs (id, mark, ...) with ``range``, numbered in descending order of (id, mark), nulls last.

    Bounds are quantiles of the ids, at most RANGES of them; an id that is several bounds, or null ids,
    are dealt over as many ranges by their mark.
    """
    rows, known = docs.agg(F.count(F.lit(1)), F.count("id")).first()
    n = min(RANGES, -(-known // rows_per_range))
    found = docs.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * RANGES)).first()[0] if n > 1 else []
    found = sorted(found or [], reverse=True)
    # One literal, not one for each bound.
    bounds = F.split(F.lit(",".join(map(str, found))), ",").cast("array<bigint>") if found else F.array().cast("array<bigint>")
    share = (F.col("mark") / F.lit(2.0**64)) + 0.5
    first = _upto(bounds, len(found), lambda b: b > F.col("id"))
    last = _upto(bounds, len(found), lambda b: b >= F.col("id"))
    nulls = max(1, min(RANGES, -(-(rows - known) // rows_per_range)))
    inside = first + F.least(F.floor(share * (last - first + 1)), last - first)
    apart = len(found) + 1 + F.least(F.floor(share * nulls), F.lit(nulls - 1))
    return docs.withColumn("range", F.when(F.col("id").isNull(), apart).otherwise(inside).cast("int"))


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rows_per_range: int | None = None, **options) -> DataFrame:
    """Each row with its edited text and how near its fingerprint is to others.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all)
    of the next row in descending order of ids (nulls last, ties by a hash of the text; after the last
    row comes the first; a single row is its own next). Returns ``id_col``, n_chars, edited_text,
    fingerprint, edited_fingerprint, near_edited, near_next; ``options`` are those of ``winnowed``. Null
    texts are empty; texts are read whole, however long; repeated rows are neighbours of each other;
    columns of other names are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    marked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    if rows_per_range is None:
        rows_per_range = max(1, docs.select(id_col).count() // max(96, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranged = _ranged(marked, rows_per_range)
    # The first row of each range also ends the range before it; that of the first ends the last.
    down = F.struct(F.col("id").isNull().alias("none"), F.bitwise_not("id").alias("down"), "mark")
    first = ranged.select("id", "mark", "range").groupBy("range").agg(F.min(down).alias("first"))
    every = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(every), F.max("range").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    first = first.select(before.alias("goes_to"), F.bitwise_not("first.down").alias("first_id"), F.col("first.mark").alias("first_mark"))
    # As many rows as there are ranges, at most 2 * RANGES.
    edge = marked.join(F.broadcast(first), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark")))
    edge = edge.select("id", "text", "mark", F.col("goes_to").alias("range"), F.lit(True).alias("edge"))
    both = ranged.select("id", "text", "mark", "range", F.lit(False).alias("edge")).unionByName(edge)
    both = both.repartition("range").withColumn("chosen", winnowed(F.col("text"), **options))
    order = Window.partitionBy("range").orderBy("edge", F.col("id").desc_nulls_last(), "mark")
    both = both.withColumn("next", F.lead(F.struct("text", "chosen")).over(order)).where(~F.col("edge"))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    out = both.select("id", n.cast("long").alias("n_chars"), edited.alias("edited_text"), "chosen", F.col("next.chosen").alias("next_chosen"))
    out = out.withColumn("edited_chosen", winnowed(F.col("edited_text"), **options))
    own = hash_set(F.col("chosen"))
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_text",
        as_text(F.col("chosen")).alias("fingerprint"), as_text(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(own, hash_set(F.col("edited_chosen"))).alias("near_edited"), likeness(own, hash_set(F.col("next_chosen"))).alias("near_next"),
    )
