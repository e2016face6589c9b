"""What the operators share: stored intermediate tables and column hygiene."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that setting is absent on one machine (tests) is a temporary
    folder made and remembered; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kvlake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let Arrow batches hold at most so many bytes (one row at least), unless the
    session's limit is lower: 10,000 rows of long texts are too much for a worker.
    Results do not depend on it.  It stays set, since plans run later."""
    now = spark.conf.get(BATCH_LIMIT).lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    if not 0 < int(now.rstrip("kmg") or 0) * unit <= most:
        spark.conf.set(BATCH_LIMIT, str(most))


def store(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs its own tasks only and a
    table used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kvlake-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; other frames are left alone."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def power_of_two(n: int, least: int, most: int) -> int:
    return 1 << max(least.bit_length() - 1, min(most.bit_length() - 1, max(n - 1, 0).bit_length()))


def size_of(df: DataFrame) -> int:
    """Bytes that Spark's statistics give for ``df``, 0 where they don't know; no job is run."""
    found = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return found if found < 1 << 57 else 0  # rows from Python have a default size beyond that


def parts_for(df: DataFrame, per_partition: int = 4, part_bytes: int = 64 << 20, least: int = 64, most: int = 1 << 21) -> int:
    """How many hash slices to cut: follows the input's size, and the session's
    shuffle partitions where they are more."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return power_of_two(max(partitions * per_partition, size_of(df) // part_bytes), least, most)
