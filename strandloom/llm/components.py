"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


class Forest:
    """Union-find over arbitrary integers; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one batch as stars around the smallest member: fewer rows, same components."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        nodes = [x for x in forest.up if forest.find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], ["v", "m"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Table (v, m): every node of ``links`` (two BIGINT columns) but the roots, with its root m.

    m is the smallest node of the component. Every round is two aggregations and joins over the
    links, stored in the shared folder; nothing is collected but a count and a checksum. Raises if
    ``rounds`` do not suffice.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v <> m")
    # Stored first: what makes the links may run in Python too, and two such steps in a row would take
    # two workers for each task.
    raw = stored(edges, "links")
    edges = stored(raw.mapInArrow(_stars, "v bigint, m bigint").distinct(), "stars")
    forget(raw)
    salts = min(64, max(8, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    state = None
    for _ in range(rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges
        state = now
        both = edges.unionByName(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy(F.col("v").alias("u")).agg(F.least(F.min("m"), F.first("v")).alias("r"))
        # The centre of a large star has very many neighbours: they are dealt over many tasks.
        least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        spread = both.where("m > v").withColumn("salt", F.pmod(F.xxhash64("m"), F.lit(salts)).cast("int"))
        large = spread.join(least.withColumnRenamed("u", "v"), ["v", "salt"]).select(F.col("m").alias("v"), F.col("r").alias("m"))
        large = large.where("v <> m").distinct()
        smallest = large.groupBy(F.col("v").alias("u")).agg(F.min("m").alias("r"))
        small = large.join(smallest, F.col("v") == F.col("u")).select("v", "m", "r")
        small = small.select(F.col("m").alias("v"), F.col("r").alias("m")).unionByName(smallest.select(F.col("u").alias("v"), F.col("r").alias("m")))
        last, edges = edges, stored(small.where("v <> m").distinct(), "stars")
        forget(last)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def runs(keys: np.ndarray) -> np.ndarray:
    """Start positions of runs of equal rows in a sorted array, with the end appended."""
    if not len(keys):
        return np.zeros(1, np.int64)
    change = np.any(keys[1:] != keys[:-1], axis=1) if keys.ndim > 1 else keys[1:] != keys[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [len(keys)]))
