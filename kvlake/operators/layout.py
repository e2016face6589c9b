"""Sorted blocks: restart points, prefix encoding, block index and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.operators import ranges

RESTART_INTERVAL = 16


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings or binaries (0 if one is null)."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    miss = F.array_position(same, F.lit(False))
    return F.coalesce(F.when(n == 0, F.lit(0)).when(miss > 0, miss - 1).otherwise(n), F.lit(0)).cast("long")


def blocks_by_rows(rows: DataFrame, per_block: int, key: str = "key") -> DataFrame:
    """Number sorted rows into blocks of a fixed row count."""
    numbered = ranges.running_total(rows, key, F.lit(1).cast("long"), "pos")
    return numbered.withColumn("block", F.floor(F.col("pos") / per_block).cast("long"))


def prefix_encode(rows: DataFrame, key: str = "key", interval: int = RESTART_INTERVAL) -> DataFrame:
    """Entries of each ``block``: a restart flag, the bytes shared with the key
    before, and the suffix.  A restart shares nothing."""
    w = Window.partitionBy("block").orderBy(key)
    entry = (F.row_number().over(w) - 1).cast("long")
    out = rows.withColumn("entry", entry).withColumn("_prev", F.lag(key).over(w))
    out = out.withColumn("is_restart", F.col("entry") % interval == 0).withColumn("restart", F.floor(F.col("entry") / interval).cast("long"))
    out = out.withColumn("shared", F.when(F.col("is_restart"), F.lit(0)).otherwise(shared_prefix(F.col("_prev"), F.col(key))).cast("long"))
    return out.withColumn("suffix", F.substring(F.col(key), F.col("shared").cast("int") + 1, F.length(key))).drop("_prev")


def prefix_decode(entries: DataFrame, by: tuple[str, ...] = ("block", "restart")) -> DataFrame:
    """Keys back from (entry, shared, suffix).  A restart group has at most the
    restart interval's entries, so its list is small."""
    items = F.array_sort(F.collect_list(F.struct("entry", "shared", "suffix")))
    step = F.aggregate(
        "items",
        F.array().cast("array<string>"),
        lambda done, e: F.concat(done, F.array(F.concat(F.when(F.size(done) > 0, F.substring(F.element_at(done, -1), F.lit(1), e["shared"].cast("int"))).otherwise(F.lit("")), e["suffix"]))),
    )
    grouped = entries.groupBy(*by).agg(items.alias("items")).withColumn("keys", step)
    return grouped.select(*by, F.explode(F.arrays_zip(F.col("items.entry").alias("entry"), F.col("keys").alias("key"))).alias("e")).select(*by, F.col("e.entry").alias("entry"), F.col("e.key").alias("key"))


def block_index(rows: DataFrame, key: str = "key") -> DataFrame:
    """An index entry per block: its largest key, rows and bytes."""
    return rows.groupBy("block").agg(F.max(key).alias("last_key"), F.count("*").alias("n_entries"))


def find_block(index: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target, the first block whose largest key is at or after it;
    past the end, the last block.

    Index entries and targets are put in one key order and each target takes
    the entry that follows, as in ``reads.seek``.
    """
    from kvlake.operators.reads import seek

    entries = index.select(F.col("last_key").alias("key"), F.lit(1).cast("long").alias("seq"), F.lit(1).cast("byte").alias("op"))
    found = seek(entries, targets.select("target"))
    end = index.agg(F.max("last_key").alias("_end"))
    found = found.join(end, F.lit(True))  # one row
    named = found.withColumn("key", F.coalesce("key", "_end")).drop("_end")
    return named.join(index.select(F.col("last_key").alias("key"), "block"), "key").select("target", "block", F.col("key").alias("last_key"))
