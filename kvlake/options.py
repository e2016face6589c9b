"""Settings of a store, their presets and checks, and the error types."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession


class KVError(Exception):
    """Base of all errors."""


class NotFound(KVError):
    pass


class AlreadyExists(KVError):
    pass


class Corruption(KVError):
    pass


class InvalidArgument(KVError, ValueError):
    pass


class Busy(KVError):
    """Another writer committed first, or a reader pins what was to go."""


class Closed(KVError):
    pass


#: Codec codes, fixed by the file format, and the Parquet codecs that stand for them.
COMPRESSION = {0: "none", 1: "snappy", 2: "lz4"}
PARQUET_CODEC = {"none": "uncompressed", "snappy": "snappy", "lz4": "lz4raw"}

MB = 1024 * 1024


@dataclass(frozen=True)
class Options:
    """Settings that mean something over Parquet runs; block and cache sizes, log
    syncing and threads are Spark's own business here."""

    create_if_missing: bool = True
    error_if_exists: bool = False
    level0_compaction_threshold: int = 4
    level_size_multiplier: int = 10
    base_level_size: int = 10 * MB
    max_levels: int = 7
    use_bloom_filter: bool = True
    bloom_filter_fp_rate: float = 0.01
    compression: str = "snappy"

    def with_(self, **changes) -> Options:
        return replace(self, **changes).validate()

    # The presets.
    @classmethod
    def for_testing(cls) -> Options:
        return cls(level0_compaction_threshold=2, base_level_size=MB, max_levels=4, use_bloom_filter=False, compression="none")

    @classmethod
    def for_high_write_throughput(cls) -> Options:
        return cls(level0_compaction_threshold=8, base_level_size=100 * MB)

    @classmethod
    def for_high_read_throughput(cls) -> Options:
        return cls(bloom_filter_fp_rate=0.001)

    def validate(self) -> Options:
        for name in ("level0_compaction_threshold", "level_size_multiplier", "base_level_size"):
            if getattr(self, name) <= 0:
                raise InvalidArgument(f"{name} must be above 0")
        if self.max_levels < 2:
            raise InvalidArgument("max_levels must be at least 2: level 0 compacts into level 1")
        if not 0 < self.bloom_filter_fp_rate < 1:
            raise InvalidArgument("bloom_filter_fp_rate must be between 0 and 1")
        if self.compression not in PARQUET_CODEC:
            raise InvalidArgument(f"unknown compression {self.compression!r}")
        return self

    def target_size(self, level: int) -> int | None:
        """Bytes a level should hold; level 0 is bounded by its file count instead."""
        return None if level == 0 else self.base_level_size * self.level_size_multiplier ** (level - 1)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, str(v)) for k, v in asdict(self).items()], "option string, setting string")
