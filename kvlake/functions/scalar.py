"""Scalar functions over keys, numbers and codes, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _le(n: Column, width: int) -> Column:
    h = F.lpad(F.hex(n.cast("long")), width * 2, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(width * 2 - 1, 0, -2)]))


def u32_le(n: Column) -> Column:
    """Four bytes, little-endian."""
    return _le(n, 4)


def u64_le(n: Column) -> Column:
    """Eight bytes, little-endian."""
    return _le(n, 8)


def from_le(raw: Column, width: int) -> Column:
    """Number of a little-endian binary (below 2**63)."""
    h = F.hex(raw)
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in range(width * 2 - 1, 0, -2)]), 16, 10).cast("long")


def encode_internal_key(key: Column, seq: Column, op: Column) -> Column:
    """Key bytes, then the sequence (u64) and the type (u8)."""
    return F.concat(key, u64_le(seq), F.unhex(F.lpad(F.hex(op.cast("long")), 2, "0")))


def decode_internal_key(raw: Column) -> Column:
    """(key, seq, op) of an encoded key; null if it is too short or of unknown type."""
    n = F.length(raw)
    seq = from_le(F.substring(raw, n - 8, F.lit(8)), 8)
    op = F.conv(F.hex(F.substring(raw, n, F.lit(1))), 16, 10).cast("byte")
    whole = F.struct(F.substring(raw, F.lit(1), n - 9).alias("key"), seq.alias("seq"), op.alias("op"))
    return F.when((n >= 9) & op.isin(0, 1), whole)


def compression_name(code: Column) -> Column:
    return F.when(code == 0, "none").when(code == 1, "snappy").when(code == 2, "lz4")
