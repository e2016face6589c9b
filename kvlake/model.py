"""The one data model: a log of versions of byte-string keys.

Rows of an op log are immutable and ``(key, seq)`` is unique.  ``value`` is null
exactly for tombstones, so an empty value is a real value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETE, PUT = 0, 1

LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.ByteType()),
        T.StructField("value", T.BinaryType()),
    ]
)

FILES = T.StructType(
    [
        T.StructField("level", T.IntegerType()),
        T.StructField("file_number", T.LongType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("smallest_key", T.BinaryType()),
        T.StructField("largest_key", T.BinaryType()),
    ]
)


def internal_order() -> list[Column]:
    """Keys ascending, newest version first, a put before a delete of one sequence."""
    return [F.col("key").asc(), F.col("seq").desc(), F.col("op").desc()]
