"""Streaming ingest of op logs.

The sequence decides which version wins, so late rows do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from kvlake.sources.store import KVStore


def latest(stream: DataFrame) -> DataFrame:
    """Latest row of each key of a stream, deletes included (complete or update mode).

    The state is one row a key, whatever the number of versions."""
    rest = [c for c in stream.columns if c not in ("key", "seq")]
    top = stream.groupBy("key").agg(F.max(F.struct("seq", *rest)).alias("_top"))
    return top.select("key", "_top.seq", *[f"_top.{c}" for c in rest])


def to_store(stream: DataFrame, store: KVStore, checkpoint: str, name: str | None = None) -> DataStreamWriter:
    """Write each micro-batch of (key, seq, op, value) as one run.

    The commit that shows a run also notes its batch, so a batch that is replayed
    after a failure is not written twice.  Batches are told apart by ``name``,
    the checkpoint's path by default: a new checkpoint is a new stream.
    """
    return stream.writeStream.foreachBatch(lambda rows, batch_id: store.ingest_stream_batch(rows, name or checkpoint, batch_id)).option("checkpointLocation", checkpoint)
