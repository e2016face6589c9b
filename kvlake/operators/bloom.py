"""Bloom filters: sizing, building, probing and their byte format.

Filters here are for explicit use.  Stores let Parquet write its own filters on
``key`` (see ``sources.store``).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.options import Corruption

# Fixed values of the filter format.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
SEEDS = (0xBC9F1D34, 0xD0E89C7B)
MIN_BITS, MAX_HASHES = 64, 30
MIN_RATE, MAX_RATE = 1e-4, 0.9999


def bits_for(n: Column, rate: Column) -> Column:
    """Bits for ``n`` keys at a false positive rate."""
    p = F.least(F.greatest(rate, F.lit(MIN_RATE)), F.lit(MAX_RATE))
    wanted = F.ceil(-n * F.ln(p) / (F.ln(F.lit(2.0)) * F.ln(F.lit(2.0))))
    return F.when(n == 0, F.lit(MIN_BITS)).otherwise(F.greatest(F.lit(MIN_BITS), wanted)).cast("long")


def hashes_for(n: Column, bits: Column) -> Column:
    """Probes per key that suit a size."""
    wanted = F.ceil(bits / n * F.ln(F.lit(2.0)))
    return F.when(n == 0, F.lit(1)).otherwise(F.least(F.greatest(wanted, F.lit(1)), F.lit(MAX_HASHES))).cast("long")


def expected_rate(n: Column, bits: Column, hashes: Column) -> Column:
    """False positive rate once ``n`` keys are in."""
    return F.when(n == 0, F.lit(0.0)).otherwise(F.pow(1 - F.exp(-hashes.cast("double") * n / bits), hashes.cast("double")))


def _size(n: int, rate: float) -> tuple[int, int]:
    if n == 0:
        return MIN_BITS, 1
    p = min(max(rate, MIN_RATE), MAX_RATE)
    m = max(MIN_BITS, int(np.ceil(-n * np.log(p) / np.log(2) ** 2)))
    return m, int(min(max(np.ceil(m / n * np.log(2)), 1), MAX_HASHES))


def key_hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both 32-bit hashes of each key: FNV-1a over length and bytes, all keys at once."""
    wide = max((len(k) for k in keys), default=0) + 8
    table = np.zeros((len(keys), wide), np.uint8)
    lengths = np.zeros(len(keys), np.int64)
    for i, k in enumerate(keys):
        table[i, : len(k) + 8] = np.frombuffer(struct.pack("<Q", len(k)) + k, np.uint8)
        lengths[i] = len(k) + 8
    out = []
    for seed in SEEDS:
        state = np.full(len(keys), FNV_OFFSET ^ seed, np.uint64)
        for j in range(wide):
            on = lengths > j
            state[on] = (state[on] ^ table[on, j]) * np.uint64(FNV_PRIME)
        out.append((state & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    return out[0], out[1]


@dataclass
class BloomFilter:
    bits: np.ndarray  # one bool a bit
    hashes: int

    @classmethod
    def sized(cls, n: int, rate: float = 0.01) -> BloomFilter:
        m, k = _size(n, rate)
        return cls(np.zeros(m, bool), k)

    def _places(self, keys: list[bytes]) -> np.ndarray:
        a, b = key_hashes(keys)
        with np.errstate(over="ignore"):
            probes = [(a + np.uint32(i) * b).astype(np.uint64) % np.uint64(len(self.bits)) for i in range(self.hashes)]
        return np.stack(probes).astype(np.int64)

    def add(self, keys: list[bytes]) -> BloomFilter:
        if keys:
            self.bits[self._places(keys).ravel()] = True
        return self

    def may_contain(self, keys: list[bytes]) -> np.ndarray:
        return self.bits[self._places(keys)].all(axis=0) if keys else np.zeros(0, bool)

    def encode(self) -> bytes:
        """Probes (u32), bits (u64), then the bits, little-endian."""
        return struct.pack("<IQ", self.hashes, len(self.bits)) + np.packbits(self.bits, bitorder="little").tobytes()

    @classmethod
    def decode(cls, raw: bytes) -> BloomFilter:
        if len(raw) < 12:
            raise Corruption("bloom filter is shorter than its header")
        k, m = struct.unpack_from("<IQ", raw)
        if len(raw) != 12 + (m + 7) // 8:
            raise Corruption("bloom filter length does not match its bits")
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=12), bitorder="little")[:m]
        return cls(bits.astype(bool), k)

    def expected_rate(self, n: int) -> float:
        return 0.0 if n == 0 else float((1 - np.exp(-self.hashes * n / len(self.bits))) ** self.hashes)


def buckets_for(keys: DataFrame, per_filter: int) -> int:
    """Hash buckets of about ``per_filter`` distinct keys."""
    return max(1, -(-keys.select("key").distinct().count() // per_filter))


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("bucket")


def build(keys: DataFrame, buckets: int, rate: float = 0.01) -> DataFrame:
    """One filter for each hash bucket of distinct keys: (bucket, n_keys, filter).

    With ``buckets_for`` a filter's size has a bound and building is parallel."""

    def fill(key, table):
        ks = table.column("key").to_pylist()
        blob = BloomFilter.sized(max(len(ks), 1), rate).add(ks).encode()
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "n_keys": pa.array([len(ks)], pa.int64()), "filter": pa.array([blob], pa.binary())})

    return keys.select("key", _bucket(buckets)).distinct().groupBy("bucket").applyInArrow(fill, "bucket int, n_keys long, filter binary")


def probe(filters: DataFrame, keys: DataFrame, buckets: int) -> DataFrame:
    """Each distinct key with whether the filter of its bucket may contain it; a
    bucket's filter is read once, beside its keys."""

    def test(asked, found):
        ks = asked.column("key").to_pylist()
        may = BloomFilter.decode(found.column("filter")[0].as_py()).may_contain(ks) if found.num_rows else np.zeros(len(ks), bool)
        return pa.table({"key": pa.array(ks, pa.binary()), "may_contain": pa.array(may)})

    asked = keys.select("key", _bucket(buckets)).distinct()
    return asked.groupBy("bucket").cogroup(filters.select("bucket", "filter").groupBy("bucket")).applyInArrow(test, "key binary, may_contain boolean")
