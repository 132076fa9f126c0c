"""Ordered scans of one key's rows over many tasks: numbering, running values, the row before.

Rows are dealt by ranges of (key, order), so that the largest root's journal is as many tasks as it needs. Each task scans
its own range; what a range contributes to the ones after it is a row per key and range, carried on in a small window. The
sorted rows are stored first, since a range's bounds come from a sample and must not be drawn twice.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART, AT = "__part", "__at"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset in a one-machine session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(sc, "_ordered_dir", None):
        sc._ordered_dir = tempfile.mkdtemp(prefix="ledgerline-")
        atexit.register(shutil.rmtree, sc._ordered_dir, True)
    return sc._ordered_dir


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again; it stays until the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        pass


def spread(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """rows, stored in order of key and order, with the number of their range and their place. Keys aren't null."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *key, *order).sortWithinPartitions(*key, *order)
    return stored(dealt.withColumn(PART, F.spark_partition_id()).withColumn(AT, F.monotonically_increasing_id()), "spread")


def _carried(scan: DataFrame, key: list[str], own: Column, fold: Column) -> DataFrame:
    """(key, range, __carry): fold over the ranges before of what each has come to."""
    per = scan.groupBy(*key, PART).agg(own.alias("__own"))
    before = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*key, PART, fold.over(before).alias("__carry"))


def number(scan: DataFrame, key: list[str], name: str) -> DataFrame:
    """scan plus a dense number from 1 per key, in order."""
    per = scan.groupBy(*key, PART).agg(F.min(AT).alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    out = scan.join(per, [*key, PART])
    return out.withColumn(name, F.col(AT) - F.col("__first") + F.col("__before") + 1).drop("__first", "__n", "__before")


def running(scan: DataFrame, key: list[str], value: Column, how: str, name: str, itself: bool = True) -> DataFrame:
    """scan plus the sum, maximum or last non-null of value over the key's rows up to this one, or up to the one before."""
    own, join = {
        "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
        "max": (F.max, lambda a, b: F.greatest(a, b)),
        "last": (lambda c: F.last(c, True), lambda a, b: F.coalesce(b, a)),
    }[how]
    rows = scan.withColumn("__v", value)
    if how == "last":
        total, fold = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(AT))), F.last("__own", True)
    else:
        total, fold = own("__v"), own("__own")
    carry = _carried(rows, key, total, fold)
    here = Window.partitionBy(*key, PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    return rows.withColumn("__here", own("__v").over(here)).join(carry, [*key, PART]).withColumn(name, join(F.col("__carry"), F.col("__here"))).drop("__v", "__here", "__carry")


def bare(scan: DataFrame) -> DataFrame:
    return scan.drop(PART, AT)
