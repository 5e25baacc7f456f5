"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Every document has a rate of its own in [0, 2], as near as possible to a plain copy: the sum over the
documents of the relative entropy of rate / 2 to one half is smallest among all rates that give each
source its target of words. The convex dual has one multiplier x per source, the sum over its documents
of 2 * log(1 + exp(x * size)) minus x * target, and its solution tilts documents exponentially by size:
rate = 2 * exp(x * size) / (1 + exp(x * size)). A source that must grow takes its long documents nearly
twice; one that must shrink keeps its short ones.

Newton iterations find the multipliers. An iteration is one distributed aggregate of gradient and Hessian
over the documents (combined by source and size first, which changes no term) and one row per source of
new multipliers. The first step starts on the near side of the solution, where the dual's gradient is
concave (target above the size) or convex (below), so no step passes it. Rates then become whole copies
by systematic rounding along documents ordered by size, and at most two documents of each power of two of
a source are flipped to close what rounding left open.

Scale: sums are of exact decimals and whole numbers, so reruns agree whatever the order of tasks.
Documents are summed within (source, size class, bucket) cells whose number grows with the input, with
offsets added afterwards, so a source or a size that a third of all rows share is dealt over many tasks.
One row per source is broadcast only up to ``broadcast_sources`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored, unused, word_count

CAP = 2
#: Rates are whole numbers of this unit while they are added up.
UNIT_BITS = 26
UNIT = 1 << UNIT_BITS
ROUNDS = 100
EXACT = "decimal(38,6)"


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """``sizes`` (source, source_size, ...) with ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all sizes; a
    target stops at twice its source's size and the excess goes to the others by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", place).withColumn("limit", CAP * F.col("source_size").cast("double"))
    # Sources fill up in the order of limit / weight; the level is what the others get per weight.
    fill = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("all", share * F.sum("source_size").over(every).cast("double"))
    rows = rows.withColumn("level", (F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # Taking a source as full raises the level while its limit is under it and lowers it afterwards.
    rows = rows.withColumn("level", F.max("level").over(every))
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return rows.select(*sizes.columns, target.alias("target"))


def tilted(x: Column, size: Column) -> Column:
    """The rate of a document of this size under the multiplier x, in [0, 2]."""
    return CAP / (1 + F.exp(-x * size))


def balance(sizes: DataFrame, sources: DataFrame, *, tolerance: float = 1e-6, rounds: int = ROUNDS, broadcast_sources: int = 100_000) -> DataFrame:
    """``sources`` (of, source_size, squares, target) with the dual's solution ``x`` and ``gap``, the words
    by which the rates still miss the target.

    ``sizes``: (source, size, n). x is null where the target is all that is allowed (rate 2), or nothing
    (rate 0), or the source has no words (rate 1). The iterations end when no source misses its target by
    more than ``tolerance`` of it, or after ``rounds``.
    """
    beside = F.broadcast if sources.count() <= broadcast_sources else (lambda df: df)
    size, target = F.col("source_size").cast("double"), F.col("target")
    inside = (size > 0) & (target > 0) & (target < CAP * size)
    # By Jensen's inequality the documents' mean size, weighted by size, gives a point on the near side.
    start = F.log(target / (CAP * size - target)) * size / F.col("squares").cast("double")
    state = stored(sources.withColumn("x", F.when(inside, start)).withColumn("gap", F.lit(None).cast("double")), "multipliers")
    for _ in range(rounds):
        live = beside(state.where("x is not null").select(F.col("of").alias("__of"), "x"))
        rows = sizes.where("size > 0").join(live, F.col("source").eqNullSafe(F.col("__of")))
        n, s = F.col("n").cast("double"), F.col("size").cast("double")
        rate = tilted(F.col("x"), s)
        step = rows.groupBy("__of").agg(F.sum((n * s * rate).cast(EXACT)).alias("words"), F.sum((n * s * s * rate * (1 - rate / CAP)).cast(EXACT)).alias("slope"))
        step = step.select("__of", F.col("words").cast("double").alias("words"), F.col("slope").cast("double").alias("slope"))
        found = state.join(beside(step), F.col("of").eqNullSafe(F.col("__of")), "left")
        gap = F.col("target") - F.col("words")
        found = found.select("of", "source_size", "squares", "target", F.when(F.col("x").isNotNull(), F.col("x") + gap / F.greatest(F.col("slope"), F.lit(1e-6))).alias("next"), F.col("x").alias("at"), gap.alias("gap"))
        # A source that is near enough keeps its multiplier, so it is settled for good.
        near = F.abs("gap") <= tolerance * F.col("target")
        last, state = state, stored(found.withColumn("x", F.when(near, F.col("at")).otherwise(F.col("next"))).select("of", "source_size", "squares", "target", "x", "gap"), "multipliers")
        forget(last)
        if state.where(F.abs("gap") > tolerance * F.col("target")).isEmpty():
            break
    return state


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cell_rows: int = 250_000, tolerance: float = 1e-6, broadcast_sources: int = 100_000) -> DataFrame:
    """One row for each row of ``docs``: id, mark (hash of the text), source, size, source_size,
    target, rate, copies, taken = copies * size.

    Size is the number of words (null: 0). No row is taken more than twice; a row of size 0 has rate 1,
    so it is copied once and takes nothing; a null source is a source of its own; ties in size and
    repeated rows have equal rates and are rounded one after the other; very long texts count whole;
    columns of other names are not read; reruns agree. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = stored(rows, "sizes")
    # One row for each length that occurs in a source.
    sizes = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    whole = F.col("n") * F.col("size")
    sums = sizes.groupBy("source").agg(F.sum(whole).alias("source_size"), F.sum(whole.cast("decimal(38,0)") * F.col("size")).cast("decimal(38,0)").alias("squares"), F.sum("n").alias("rows"))
    sums = stored(sums, "source-sizes")
    total = sums.agg(F.sum("rows")).first()[0] or 0
    sources = targets(sums.drop("rows"), weights, share).withColumnRenamed("source", "of")
    sources = balance(sizes, sources, tolerance=tolerance, broadcast_sources=broadcast_sources)
    beside = F.broadcast if sources.count() <= broadcast_sources else (lambda df: df)

    buckets = max(16, -(-total // cell_rows))
    cell = ["source", "class", "bucket"]
    s, target = F.col("size").cast("double"), F.col("target")
    rate = F.when(F.col("x").isNotNull() & (s > 0), tilted(F.col("x"), s)).when((s <= 0) | (F.col("source_size") <= 0), F.lit(1.0)).when(target > 0, F.lit(float(CAP))).otherwise(F.lit(0.0))
    rows = rows.join(beside(sources.drop("squares", "gap")), F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    rows = rows.withColumn("units", F.round(F.col("rate") * UNIT).cast("bigint"))
    rows = rows.withColumn("class", F.floor(3 * F.log2(F.col("size") + 1.0)).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("id", "mark"), F.lit(buckets)).cast("int"))
    own = Window.partitionBy(*cell).orderBy("size", "mark", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("own", F.row_number().over(Window.partitionBy(*cell).orderBy("size", "mark", "id"))).withColumn("sum", F.sum("units").over(own))
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("u"))
    ahead = Window.partitionBy("source").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), F.coalesce(F.sum("u").over(ahead), F.lit(0)).alias("before"))
    ranked = ranked.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("bucket") == F.col("b")))
    upto = F.col("sum") + F.col("before") + UNIT // 2
    copies = F.shiftright(upto, UNIT_BITS) - F.shiftright(upto - F.col("units"), UNIT_BITS)
    ranked = ranked.select("id", "mark", "source", "size", "source_size", "target", (F.col("own") + F.col("ahead")).alias("rank"), "rate", copies.cast("int").alias("copies"))
    ranked = stored(ranked, "copies")

    # What rounding left open, and two documents of each power of two that could close it.
    open_ = ranked.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("open"))
    power = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    can_add = (F.col("copies") < CAP) & (F.col("rate") < CAP)
    can_cut = F.col("copies") > 0
    spare = ranked.where("size > 0 and rate > 0").select("source", power.alias("power"), F.explode(F.filter(F.array(F.when(can_add, 1), F.when(can_cut, -1)), lambda x: x.isNotNull())).alias("sign"), F.struct("mark", "rank", "size").alias("d"))
    spare = spare.groupBy("source", "power", "sign").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    spare = spare.groupBy("source", "sign").agg(F.array_distinct(F.flatten(F.collect_list(F.array("lo", "hi")))).alias("spare")).select(F.col("source").alias("s"), "sign", "spare")
    chosen = spare.join(beside(open_), F.col("s").eqNullSafe(open_["source"])).where(F.signum("open") == F.col("sign"))
    by_size = F.reverse(F.array_sort(F.transform("spare", lambda x: F.struct(x["size"].alias("size"), x["rank"].cast("long").alias("rank")))))
    none = F.array().cast("array<bigint>")
    picked = F.aggregate(
        by_size,
        F.struct(F.abs("open").cast("double").alias("open"), none.alias("picks")),
        lambda a, x: F.when(x["size"] <= a["open"], F.struct((a["open"] - x["size"]).cast("double").alias("open"), F.concat(a["picks"], F.array(x["rank"])).alias("picks"))).otherwise(a),
        lambda a: a["picks"],
    )
    # At most two rows for each power of two of a source.
    flips = chosen.select("s", "sign", F.explode(picked).alias("r"))
    out = ranked.join(beside(flips), F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r")), "left")
    copies = F.col("copies") + F.coalesce("sign", F.lit(0))
    return out.select("id", "mark", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0, 1 or 2 times); columns stay as they are.

    Rows of equal id and text are told apart by their source alone; equal rows share their copies
    evenly where the number allows and the total is that of the mix. Other edge cases are those of ``mix``.
    """
    plan = mix(docs, id_col, text_col, source_col, **options)
    plan = plan.groupBy("id", "mark", "source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    doc, mark, source, copies, n, times, one = unused(docs, "__id", "__mark", "__source", "__copies", "__n", "__times", "__copy")
    plan = stored(plan.select(F.col("id").alias(doc), F.col("mark").alias(mark), F.col("source").alias(source), F.col("copies").alias(copies), F.col("n").alias(n)), "plan")
    same = docs[id_col].eqNullSafe(F.col(doc)) & (F.xxhash64(docs[text_col]) == F.col(mark)) & docs[source_col].cast("string").eqNullSafe(F.col(source))
    joined = docs.join(plan.where(F.col(copies) > 0), same).withColumn(times, F.col(copies))
    if not plan.where(F.col(n) > 1).isEmpty():
        turn = F.row_number().over(Window.partitionBy(doc, mark, source).orderBy(F.lit(1)))
        joined = joined.withColumn(times, F.floor(F.col(copies) * turn / F.col(n)) - F.floor(F.col(copies) * (turn - 1) / F.col(n)))
    return joined.withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int")))).select(*[docs[c] for c in docs.columns])
