"""Version resolution: which row of a log is seen at a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlake.model import PUT, internal_order

#: Types that a hash aggregate can keep in its buffer in place.
_FIXED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def newest(log: DataFrame, max_seq: int | None = None, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """The newest row of each key with ``seq <= max_seq``, tombstones included.

    Fixed-width payloads go through a hash aggregate with map-side combine, so
    a hot key is reduced before the shuffle.  Otherwise a ranking window is
    used, which Spark also limits before the shuffle (WindowGroupLimit).  A
    filter on ``key`` above or below reaches the scan either way.
    """
    if max_seq is not None:
        log = log.where(F.col("seq") <= F.lit(max_seq))
    rest = [f for f in log.schema.fields if f.name not in (*by, "seq")]
    if all(isinstance(f.dataType, _FIXED) for f in rest):
        # a null value is a tombstone's, and max_by keeps the null of the newest row
        picked = log.groupBy(*by).agg(F.max("seq").alias("seq"), *[F.max_by(f.name, "seq").alias(f.name) for f in rest])
        return picked.select(*log.columns)
    order = Window.partitionBy(*by).orderBy(F.col("seq").desc(), F.col("op").desc())
    return log.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def visible(log: DataFrame, max_seq: int | None = None, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Live rows at ``max_seq``.  Deletes are dropped after resolution, never before."""
    return newest(log, max_seq, by).where(F.col("op") == PUT)


def history(log: DataFrame) -> DataFrame:
    """All versions, each key's newest first."""
    return log.orderBy(*internal_order())


def in_range(key: Column, start=None, end=None) -> Column:
    """Half-open range test; an absent bound is open."""
    test = F.lit(True)
    if start is not None:
        test = test & (key >= F.lit(start))
    if end is not None:
        test = test & (key < F.lit(end))
    return test


def retained(log: DataFrame, pins: list[int], drop_tombstones: bool) -> DataFrame:
    """Rows that compaction must keep: for each pinned sequence, and for the
    latest state, the newest row of each key.

    With ``drop_tombstones`` the oldest tombstones kept go: they say no more than
    an absent key does.  Each pin's row is an aggregate with map-side combine, so
    a key of very many versions is no one task's load; null pins don't count.
    """
    names = log.columns
    rest = [n for n in names if n not in ("key", "seq")]
    row = F.struct("seq", *rest)
    kept = [F.max(F.when(F.col("seq") <= F.lit(int(p)), row)) for p in sorted(set(pins))] + [F.max(row)]
    found = log.groupBy("key").agg(F.array_sort(F.array_distinct(F.array_compact(F.array(*kept)))).alias("_rows"))
    if drop_tombstones:
        first = F.array_position(F.transform("_rows", lambda r: r["op"] == PUT), F.lit(True))
        found = found.where(first > 0).withColumn("_rows", F.slice("_rows", first.cast("int"), F.size("_rows")))
    return found.select("key", F.explode("_rows").alias("_row")).select(*[F.col(n) if n == "key" else F.col(f"_row.{n}") for n in names])
