"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments. With means m and deviations s of a segment of n
components, the squared distance of two segments is at least n * ((m1 - m2)^2 + (s1 - s2)^2), so an
inner product is at most the sum of n * (m1 * m2 + s1 * s2). Candidates that stay under a query's
k-th score are dropped at the coarsest resolution that shows it; survivors are computed exactly.

Scale: queries go in waves of about ``block`` vectors. A wave is the only part of the queries that is on
the driver and broadcast at a time; it is one pass over all candidates, each task keeps k rows for each
query, and the final choice is k rows per query and task. The rows of a wave are stored before the next
one starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, sliced, stored

LEVELS = (1, 4, 16)


def scaled(vectors: list) -> list[np.ndarray | None]:
    """floor(1024 * x) of each component as doubles; None where a vector takes no part."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None if v is None or any(c is None for c in v) else np.asarray(v, np.float64)
        out.append(None if x is None or not np.isfinite(x).all() else np.floor(1024 * x))
    return out


def statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows [sqrt(n) * mean, sqrt(n) * deviation] of each segment; their product bounds the inner product."""
    cuts = [x.shape[1] * i // parts for i in range(parts + 1)]
    cols = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            seg = x[:, a:b]
            mean = seg.mean(axis=1)
            cols += [np.sqrt(b - a) * mean, np.sqrt(b - a) * seg.std(axis=1)]
    return np.stack(cols, axis=1) if cols else np.zeros((len(x), 1))


def _search(wave, k: int):
    """wave: broadcast {dimension: (ids, marks, vectors)}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {d: (ids, x, [statistics(x, p) for p in LEVELS]) for d, (ids, _, x) in wave.value.items()}
        best = {d: (np.full((len(q[0]), k), -np.inf), np.zeros((len(q[0]), k), np.int64)) for d, q in queries.items()}
        for batch in sliced(batches):
            ids = np.array([-1 if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            known = [i is not None for i in batch.column(0).to_pylist()]
            vectors = scaled(batch.column(1).to_pylist())
            for d, (qids, x, qstats) in queries.items():
                own = [i for i, v in enumerate(vectors) if v is not None and known[i] and len(v) == d]
                if not own:
                    continue
                y, yid = np.stack([vectors[i] for i in own]), ids[own]
                stats = [statistics(y, p) for p in LEVELS]
                coarse = qstats[0] @ stats[0].T
                scores, names = best[d]
                # Far above what rounding can take from a bound.
                slacks = 1e-9 * np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1).max()
                for q in range(len(qids)):
                    floor, slack = scores[q, -1], slacks[q]
                    left = np.flatnonzero((coarse[q] >= floor - slack) & (yid != qids[q]))
                    for level in (1, 2):
                        if len(left):
                            left = left[stats[level][left] @ qstats[level][q] >= floor - slack]
                    if not len(left):
                        continue
                    exact = y[left] @ x[q]
                    s, n = np.concatenate([scores[q], exact]), np.concatenate([names[q], yid[left]])
                    top = np.lexsort((n, -s))[:k]
                    scores[q], names[q] = s[top], n[top]
        for d, (qids, marks, _) in wave.value.items():
            scores, names = best[d]
            r, c = np.nonzero(np.isfinite(scores))
            yield pa.RecordBatch.from_arrays([pa.array(qids[r]), pa.array(marks[r]), pa.array(names[r, c]), pa.array(scores[r, c].astype(np.int64))], ["query_id", "mark", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 10, block: int = 4096) -> DataFrame:
    """The ``k`` highest scores of every query against all other rows: query_id, rank, vec_id, score.

    A score is the integer inner product of floor(1024 * x); ties go to the smaller id; a row is no
    candidate of a query of the same id. Rows take no part if their id, their vector or a component is
    null or a component is not finite; vectors of other lengths than the query's are no candidates.
    Repeated candidates are candidates of their own. Queries of one id and equal vectors are one query;
    those of one id and different vectors are each answered, with ranks of their own. Scores are exact
    while sums stay below 2^53. Columns of other names are not read. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
    asked = asked.withColumn("mark", F.xxhash64("id", "v")).dropDuplicates(["mark"])
    waves = max(1, -(-asked.count() // block))
    asked = stored(asked, "queries") if waves > 1 else asked
    paths = []
    for wave in range(waves):
        held: dict[int, tuple[list, list, list]] = {}
        for r in asked.where(F.pmod("mark", F.lit(waves)) == wave).collect():
            (x,) = scaled([r["v"]])
            if x is not None and len(x):
                for column, value in zip(held.setdefault(len(x), ([], [], [])), (r["id"], r["mark"], x), strict=True):
                    column.append(value)
        shared = spark.sparkContext.broadcast({d: (np.array(i, np.int64), np.array(m, np.int64), np.stack(x)) for d, (i, m, x) in held.items()})
        every = rows.mapInArrow(_search(shared, k), "query_id bigint, mark bigint, vec_id bigint, score bigint")
        order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
        best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if waves == 1:
            return best
        paths.append(stored(best, "wave").kept_at)
        shared.unpersist()
    forget(asked)
    return spark.read.schema(best.schema).parquet(*paths)
