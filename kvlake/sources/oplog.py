"""Op logs, runs, edits and accesses as views over the given tables.

``events`` is the natural log: event ids are unique and ascending, so
``seq = event_id + 1``; the key is the user; an ``error`` is a delete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op():
    return F.when(F.col("event_type") == "error", 0).otherwise(1).cast("byte")


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key long, seq, op, value double): fixed width, for hash aggregates."""
    e = table(spark, sf_dir, "events")
    op = _op()
    return e.select(F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("seq"), op.alias("op"), F.when(op == 1, F.col("value")).alias("value"))


def text_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key string, seq, op, value string): keys ``user:000012:click`` sort by user."""
    e = table(spark, sf_dir, "events")
    op = _op()
    key = F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(":"), F.col("event_type"))
    return e.select(key.alias("key"), (F.col("event_id") + 1).alias("seq"), op.alias("op"), F.when(op == 1, F.col("props")).alias("value"))


def runs(spark: SparkSession, sf_dir: str, n: int = 4) -> DataFrame:
    """The log cut into ``n`` runs by sequence; ``prio`` 0 is the newest."""
    log = oplog(spark, sf_dir)
    run = F.pmod(F.floor(F.col("seq") / 64), F.lit(n)).cast("int")
    return log.withColumn("run", run).withColumn("prio", (F.lit(n - 1) - run).cast("int"))


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted text keys ``order:00000001`` with their rows' sizes."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("order:"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("key"), F.col("o_orderkey"), F.col("o_totalprice").alias("value"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's edits: a file for each order, deleted again for some."""
    o = table(spark, sf_dir, "orders")
    file = o.select(
        (F.col("o_orderkey") * 2).alias("edit_pos"), F.lit("AddFile").alias("kind"), (F.col("o_custkey") % 4).cast("int").alias("level"), F.col("o_orderkey").alias("file_number"),
        (F.floor("o_totalprice")).cast("long").alias("file_size"), F.col("o_orderkey").alias("smallest_key"), (F.col("o_orderkey") + F.col("o_custkey") % 50).alias("largest_key"),
    )
    gone = file.where("file_number % 3 = 0").select(
        (F.col("edit_pos") + 5).alias("edit_pos"), F.lit("DeleteFile").alias("kind"), "level", "file_number", F.lit(None).cast("long").alias("file_size"), F.lit(None).cast("long").alias("smallest_key"), F.lit(None).cast("long").alias("largest_key")
    )
    return file.unionByName(gone)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries: the texts of documents as bytes."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block reads: users' blocks; the whole log is one cache."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit(0).cast("long").alias("shard"), F.col("event_id").alias("access_id"), F.col("user_id").alias("block"))
