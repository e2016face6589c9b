"""Lookups, ordered scans, cursors and counts over a log.

Each takes any frame with ``key, seq, op`` and payload columns.  Range tests
are placed on ``key`` below version resolution, so Parquet sees them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.operators import ranges
from kvlake.operators.mvcc import in_range, visible


def get(log: DataFrame, key, max_seq: int | None = None) -> DataFrame:
    """The live row of one key: one row or none."""
    return visible(log.where(F.col("key") == F.lit(key)), max_seq)


def multi_get(log: DataFrame, keys: DataFrame, max_seq: int | None = None) -> DataFrame:
    """One row per wanted key; absent and deleted keys have a null payload.

    The log is reduced to the wanted keys first (a semi join, broadcast only if
    Spark finds the key list under its threshold), then resolved and joined.
    """
    wanted = keys.select("key")
    state = visible(log.join(wanted, "key", "left_semi"), max_seq)
    return wanted.join(state, "key", "left")


def scan(log: DataFrame, start=None, end=None, max_seq: int | None = None) -> DataFrame:
    """Live rows with start <= key < end, ascending."""
    return visible(log.where(in_range(F.col("key"), start, end)), max_seq).orderBy("key")


def prefix_scan(log: DataFrame, prefix, max_seq: int | None = None) -> DataFrame:
    return visible(log.where(F.col("key").startswith(F.lit(prefix))), max_seq).orderBy("key")


def prefix_count(log: DataFrame, prefix: Column, max_seq: int | None = None) -> DataFrame:
    """Live keys per prefix expression."""
    return visible(log, max_seq).groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n_keys"))


def range_stats(log: DataFrame, by: Column, value: str = "value", start=None, end=None, max_seq: int | None = None) -> DataFrame:
    """Count, sum, least and greatest value of the live keys of each ``by`` (a
    prefix expression, say) within [start, end), at a sequence."""
    live = visible(log.where(in_range(F.col("key"), start, end)), max_seq)
    return live.groupBy(by.alias("prefix")).agg(
        F.count("*").alias("n_keys"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest")
    )


def _seek(log: DataFrame, targets: DataFrame, max_seq: int | None, forward: bool) -> DataFrame:
    """Keys and targets are put in one order, and each target takes the key that
    was met last, walking towards it: a sort instead of a range join.  Targets
    that meet none in their range take the nearest range's edge."""
    keys = visible(log, max_seq).select(F.col("key").alias("k"), F.lit(1).alias("_is_key"))
    wanted = targets.select(F.col("target").alias("k"), F.lit(0).alias("_is_key"))
    dealt = ranges.deal(keys.unionByName(wanted), "k")
    walk = F.col("k").desc() if forward else F.col("k").asc()
    met = Window.partitionBy(ranges.PART).orderBy(walk, F.col("_is_key").desc()).rowsBetween(Window.unboundedPreceding, 0)
    key = F.when(F.col("_is_key") == 1, F.col("k"))
    here = dealt.withColumn("found", F.last(key, ignorenulls=True).over(met)).where("_is_key = 0")
    edges = ranges.across(dealt, _edge=F.min(key) if forward else F.max(key))
    bridge = edges.select(ranges.PART, (ranges.following if forward else ranges.preceding)("_edge").alias("_bridge"))
    return here.join(bridge, ranges.PART).select(F.col("k").alias("target"), F.coalesce("found", "_bridge").alias("key"))


def seek(log: DataFrame, targets: DataFrame, max_seq: int | None = None) -> DataFrame:
    """For each ``target``, the first live key at or after it (null if none)."""
    return _seek(log, targets, max_seq, True)


def seek_back(log: DataFrame, targets: DataFrame, max_seq: int | None = None) -> DataFrame:
    """For each ``target``, the last live key at or before it (null if none)."""
    return _seek(log, targets, max_seq, False)


def seek_one(log: DataFrame, target, max_seq: int | None = None) -> DataFrame:
    return visible(log.where(F.col("key") >= F.lit(target)), max_seq).orderBy("key").limit(1)


def first(log: DataFrame, max_seq: int | None = None) -> DataFrame:
    return visible(log, max_seq).orderBy("key").limit(1)


def last(log: DataFrame, max_seq: int | None = None) -> DataFrame:
    return visible(log, max_seq).orderBy(F.col("key").desc()).limit(1)


def next_after(log: DataFrame, key, max_seq: int | None = None) -> DataFrame:
    return visible(log.where(F.col("key") > F.lit(key)), max_seq).orderBy("key").limit(1)


def prev_before(log: DataFrame, key, max_seq: int | None = None) -> DataFrame:
    """The greatest live key below; a deleted neighbour is passed over."""
    return visible(log.where(F.col("key") < F.lit(key)), max_seq).orderBy(F.col("key").desc()).limit(1)


def neighbours(log: DataFrame, max_seq: int | None = None) -> DataFrame:
    """Each live key with the next and previous one."""
    dealt = ranges.deal(visible(log, max_seq), "key")
    order = Window.partitionBy(ranges.PART).orderBy("key")
    inner = dealt.withColumn("next_key", F.lead("key").over(order)).withColumn("prev_key", F.lag("key").over(order))
    edges = ranges.across(dealt, _lo=F.min("key"), _hi=F.max("key"))
    edges = edges.select(ranges.PART, ranges.following("_lo").alias("_after"), ranges.preceding("_hi").alias("_before"))
    out = inner.join(edges, ranges.PART)
    return out.withColumn("next_key", F.coalesce("next_key", "_after")).withColumn("prev_key", F.coalesce("prev_key", "_before")).drop(ranges.PART, "_after", "_before")


def page(log: DataFrame, after=None, size: int = 100, max_seq: int | None = None) -> DataFrame:
    """Keyset paging: the next ``size`` live rows after a key."""
    rows = log if after is None else log.where(F.col("key") > F.lit(after))
    return visible(rows, max_seq).orderBy("key").limit(size)


def diff(log: DataFrame, old_seq: int, new_seq: int, payload: str = "value") -> DataFrame:
    """Keys that differ between two snapshots: added, removed or changed.

    Only keys written in between can differ, so only those are resolved.
    """
    written = log.where((F.col("seq") > old_seq) & (F.col("seq") <= new_seq)).select("key").distinct()
    some = log.join(written, "key", "left_semi")
    old = visible(some, old_seq).select("key", F.col(payload).alias("old_value"), F.lit(True).alias("_old"))
    new = visible(some, new_seq).select("key", F.col(payload).alias("new_value"), F.lit(True).alias("_new"))
    both = old.join(new, "key", "full")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return both.withColumn("change", kind).where("change is not null").drop("_old", "_new")


def log_stats(log: DataFrame) -> DataFrame:
    """Length, byte estimate and sequence range of a memtable."""
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + 16
    return log.agg(F.count("*").alias("n_entries"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("approximate_size"), F.min("seq").alias("start_seq"), F.max("seq").alias("last_seq"))


def keys(log: DataFrame) -> DataFrame:
    """Distinct keys, deleted ones included, ascending."""
    return log.select("key").distinct().orderBy("key")
