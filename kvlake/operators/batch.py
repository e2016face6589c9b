"""Atomic write batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.model import DELETE, PUT


class WriteBatch:
    """An ordered list of puts and deletes that take effect together.

    Later operations on a key win.  The size estimate counts key and value
    bytes plus 8 for a put and 4 for a delete.
    """

    def __init__(self) -> None:
        self._ops: list[tuple[int, bytes, bytes | None]] = []
        self._size = 0

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self._ops.append((PUT, bytes(key), bytes(value)))
        self._size += len(key) + len(value) + 8
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self._ops.append((DELETE, bytes(key), None))
        self._size += len(key) + 4
        return self

    def clear(self) -> None:
        self._ops.clear()
        self._size = 0

    def __len__(self) -> int:
        return len(self._ops)

    def is_empty(self) -> bool:
        return not self._ops

    def approximate_size(self) -> int:
        return self._size

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes | None]]:
        return iter(self._ops)

    def to_frame(self, spark: SparkSession, base_seq: int = 0) -> DataFrame:
        """Rows of the op log, with consecutive sequences after ``base_seq``."""
        rows = [(k, base_seq + i, op, v) for i, (op, k, v) in enumerate(self._ops, 1)]
        return spark.createDataFrame(rows, "key binary, seq long, op byte, value binary")


def apply_batch(log: DataFrame, batch: DataFrame, base_seq: int | Column, position: str = "pos") -> DataFrame:
    """The log with a batch appended.  ``batch`` numbers its operations from 1
    in ``position``, so sequences need no sort."""
    seq = (F.lit(base_seq) if isinstance(base_seq, int) else base_seq) + F.col(position)
    return log.unionByName(batch.withColumn("seq", seq.cast("long")).select(*log.columns))


def batch_size(batch: DataFrame) -> DataFrame:
    """Operations and estimated bytes of a batch."""
    size = F.length("key") + F.when(F.col("op") == PUT, F.length("value") + 8).otherwise(4)
    return batch.agg(F.count("*").alias("n_ops"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("approximate_size"))
