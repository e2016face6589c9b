"""LRU block cache, as counters over an access log.

Spark's own caching serves stores; these operators answer what a cache of a
given size would have done for a recorded list of block reads.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.operators.ranges import pinned


def _earlier_greater(values: np.ndarray) -> np.ndarray:
    """For each of distinct ``values``, how many before it are greater.

    Each such pair is counted at the highest bit in which its ranks differ.
    """
    rank = np.empty(len(values), dtype=np.int64)
    rank[np.argsort(values)] = np.arange(len(values))
    out = np.zeros(len(values), dtype=np.int64)
    for bit in range(max(len(values) - 1, 0).bit_length()):
        high = rank >> (bit + 1)
        at = np.argsort(high, kind="stable")
        one = (rank[at] >> bit) & 1
        seen = np.concatenate(([0], np.cumsum(one)))
        first = np.searchsorted(high[at], high[at])
        out[at] += np.where(one == 0, seen[:-1] - seen[first], 0)
    return out


def _inside(by: list[str], name: str):
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by)
        pdf[name] = _earlier_greater(pdf["_prev"].to_numpy())
        return pdf

    return count


def stack_distance(accesses: DataFrame, order: str = "access_id", block: str = "block", shard: str = "shard") -> DataFrame:
    """For each access, how many distinct other blocks were read since this block was last.

    A cache of ``c`` equal blocks hits exactly if the distance is below ``c``.
    Accesses are independent across cache shards; a shard may be the whole log.

    Accesses are numbered in order.  Those between an access and its previous
    one, less those whose own previous access is in between too, are the distinct
    blocks.  The latter are the earlier accesses with a later previous one: inside
    a range of numbers or of previous numbers they are counted range by range, and
    between ranges from totals of the pairs of ranges.  A range holds about four
    times the root of all accesses.
    """
    spark = accesses.sparkSession
    n = accesses.count()
    size = 4 * math.isqrt(n) + 1
    ranges = n // size + 1
    # kept, as a second run could cut the ranges elsewhere
    dealt = pinned(accesses.select(shard, block, order).repartitionByRange(ranges, shard, order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    starts = totals.select(F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(shard, order))
    ranked = dealt.withColumn("_rank", rank).join(starts, F.col("_p") == F.col("_part")).select(shard, block, order, (F.col("_start") + F.col("_rank") - 1).cast("long").alias("_pos"))
    linked = ranked.withColumn("_prev", F.lag("_pos").over(Window.partitionBy(shard, block).orderBy("_pos")))
    again = linked.where("_prev is not null").select("_pos", "_prev", *[F.floor(F.col(c) / size).cast("long").alias(to) for c, to in (("_pos", "_to"), ("_prev", "_from"))])
    columns = "_pos long, _prev long, _to long, _from long, _same long"
    # of one range of numbers; then of one range of previous numbers, read in an earlier range
    local = again.groupBy("_to").applyInPandas(_inside(["_pos"], "_same"), columns)
    local = local.groupBy("_from").applyInPandas(_inside(["_to", "_prev"], "_near"), f"{columns}, _near long")
    cells = again.groupBy("_to", "_from").agg(F.count("*").alias("_n"))
    grid = spark.range(ranges).select(F.col("id").alias("_to"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id"))).alias("_from")).join(cells, ["_to", "_from"], "left")
    earlier = F.sum("_n").over(Window.partitionBy("_from").orderBy("_to").rowsBetween(Window.unboundedPreceding, -1))
    later = F.sum("_e").over(Window.partitionBy("_to").orderBy(F.col("_from").desc()).rowsBetween(Window.unboundedPreceding, -1))
    far = grid.withColumn("_e", earlier).withColumn("_far", later).where("_n is not null").select("_to", "_from", "_far")
    inner = F.col("_pos") - F.col("_prev") - 1 - F.col("_same") - F.col("_near") - F.coalesce("_far", F.lit(0))
    counted = local.join(far, ["_to", "_from"]).select("_pos", inner.cast("long").alias("distance"))
    return linked.join(counted, "_pos", "left").select(shard, block, order, "distance")


def cache_stats(distances: DataFrame, capacity: int) -> DataFrame:
    """Counters of a cache of ``capacity`` equal blocks per shard."""
    hit = F.coalesce(F.col("distance") < capacity, F.lit(False))
    counts = distances.agg(F.count("*").alias("lookups"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("hits"))
    misses = F.col("lookups") - F.col("hits")
    rate = F.when(F.col("lookups") == 0, F.lit(0.0)).otherwise(F.col("hits") / F.col("lookups"))
    return counts.select("lookups", "hits", misses.alias("misses"), misses.alias("insertions"), rate.alias("hit_rate"))


def hits_by_shard(distances: DataFrame, capacity: int, shard: str = "shard") -> DataFrame:
    """Lookups and hits of each shard's cache of ``capacity`` equal blocks."""
    hit = F.coalesce(F.col("distance") < capacity, F.lit(False))
    return distances.groupBy(shard).agg(F.count("*").alias("lookups"), F.sum(hit.cast("long")).alias("hits"))
