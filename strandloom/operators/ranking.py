"""Global row numbers without a single task, and tables kept in the shared folder.

Rows are dealt by ranges of the keys, numbered within a range, and shifted by the sizes of the ranges
before it. The sizes are one row per range: a bounded number that is broadcast.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables of this process that are still there: path -> session.
_KEPT: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a temporary folder, but only if Spark runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strandloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{found}")
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors.

    The table stays until ``forget`` or ``clear`` is called or the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def kept_folder(spark: SparkSession, name: str) -> str | None:
    """A new folder for plain files in the shared folder, which stays as tables do; None where that is not
    a path that Python can open."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    if path.getScheme() != "file":
        return None
    os.makedirs(path.getPath())
    _KEPT[f"file://{path.getPath()}"] = spark
    return path.getPath()


def forget_folder(path: str) -> None:
    """Delete a folder made by ``kept_folder``."""
    _KEPT.pop(f"file://{path}", None)
    shutil.rmtree(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def forget(*tables: DataFrame | None) -> None:
    """Delete tables made by ``kept`` that nothing reads any more, and what was shuffled to make them."""
    spark = None
    for table in tables:
        path = getattr(table, "kept_at", None)
        if path and _KEPT.pop(path, None):
            spark = table.sparkSession
            _delete(spark, path)
    if spark is not None:
        release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished jobs: it keeps them until the driver collects its garbage,
    which a few large jobs or many small ones do not bring about."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def clear() -> None:
    """Delete all tables that ``kept`` has made in this process; results that read them are lost."""
    while _KEPT:
        path, spark = _KEPT.popitem()
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(spark, path)


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with ``name``: 0, 1, ... in the order of ``keys`` (which must tell all rows apart)."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = kept(df.repartitionByRange(n, *keys).withColumn("__range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__range", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    return ranged.withColumn("__own", own).join(F.broadcast(sizes), "__range").withColumn(name, (F.col("__own") + F.col("__before")).cast("bigint")).drop("__range", "__own", "__before")


def ranked(df: DataFrame, keys: list[str], name: str, same: str | None = None) -> DataFrame:
    """df with ``name``: the number of rows with smaller keys, and ``same``: the number with equal keys.
    Equal keys are one row while they are sorted, so a key that many rows share is no hot spot of the sort."""
    places = ranked_keys(df, keys, name)
    return df.join(places.select(*keys, name, *([F.col("__rows").alias(same)] if same else [])), keys)


def ranked_keys(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys..., __rows, name): the distinct keys of df with their rows and the number of rows before them.
    ``forget`` deletes what it reads."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = kept(groups.repartitionByRange(n, *keys).withColumn("__range", F.spark_partition_id()), "ranged")
    sizes = held.groupBy("__range").agg(F.sum("__rows").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__range", before.alias("__before"))
    own = F.coalesce(F.sum("__rows").over(Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = held.withColumn("__own", own).join(F.broadcast(sizes), "__range")
    out = ranged.select(*keys, "__rows", (F.col("__own") + F.col("__before")).cast("bigint").alias(name))
    out.kept_at = held.kept_at
    return out
