"""Rows dealt into ranges of a key, and what holds across the ranges' edges.

A window without a partition puts all rows in one task.  Here rows are dealt by
range, ordered within each, and the edges are bridged by a table of one row a
range.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART = "_part"


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine (tests), a temporary folder where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kvlake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written once, as Parquet in the shared folder, for all its users.

    Ranges are cut from samples, so two uses of an unpinned frame could be dealt
    differently."""
    path = f"{_folder(df.sparkSession)}/kvlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` in ranges of ``by``, each with its range's number, which ascends."""
    return pinned(rows.repartitionByRange(*[F.col(c) for c in by]).withColumn(PART, F.spark_partition_id()))


def across(dealt: DataFrame, **edges: Column) -> DataFrame:
    """A row a range with aggregates ``edges``: its number, and them."""
    return dealt.groupBy(PART).agg(*[c.alias(n) for n, c in edges.items()])


def following(n: str) -> Column:
    """The next range's value of an edge column that is not null."""
    return F.first(n, ignorenulls=True).over(Window.orderBy(PART).rowsBetween(1, Window.unboundedFollowing))


def preceding(n: str) -> Column:
    return F.last(n, ignorenulls=True).over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))


def total_before(n: str) -> Column:
    return F.coalesce(F.sum(n).over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def running_total(rows: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows of smaller keys (keys are unique)."""
    dealt = deal(rows.withColumn("_v", value), key)
    starts = across(dealt, _sum=F.sum("_v")).select(PART, total_before("_sum").alias("_start"))
    within = F.coalesce(F.sum("_v").over(Window.partitionBy(PART).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn(out, within).join(starts, PART).withColumn(out, F.col(out) + F.col("_start")).drop(PART, "_v", "_start")
