"""A store: sorted Parquet runs under a versioned manifest.

A write is a DataFrame, written as one run and made visible by one commit.  Runs
number their rows from 1; the commit gives them their place among the sequences,
so writers that meet only commit again.  Readers see one manifest version.
Compaction replaces runs and deletes nothing; ``vacuum`` deletes what no version
in use needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlake.model import LOG
from kvlake.operators import mvcc, reads
from kvlake.operators.batch import WriteBatch
from kvlake.options import PARQUET_CODEC, AlreadyExists, Busy, Closed, NotFound, Options
from kvlake.sources import manifest as man

TRIES = 50


class View:
    """Reads of one manifest version."""

    def __init__(self, spark: SparkSession, path: str, manifest: man.Manifest):
        self.spark, self.path, self.manifest = spark, path, manifest

    def _rows(self, runs: list[man.Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], LOG)
        rows = self.spark.read.schema(T.StructType([*LOG.fields, T.StructField("run", T.StringType())])).option("basePath", self.path).parquet(*[f"{self.path}/run={r.name}" for r in runs])
        bases = [x for r in runs if r.base for x in (F.lit(r.name), F.lit(r.base).cast("long"))]
        if bases:
            rows = rows.withColumn("seq", F.col("seq") + F.coalesce(F.try_element_at(F.create_map(*bases), F.col("run")), F.lit(0)))
        return rows.select(*LOG.names)

    def log(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All versions in runs that may hold keys of [low, high]."""
        return self._rows([r for r in self.manifest.runs if r.overlaps(low, high)])

    def get(self, key: bytes, max_seq: int | None = None) -> bytes | None:
        row = reads.get(self.log(key, key), key, max_seq).first()
        return None if row is None else bytes(row["value"])

    def multi_get(self, keys: DataFrame, max_seq: int | None = None) -> DataFrame:
        return reads.multi_get(self.log(), keys, max_seq)

    def scan(self, start: bytes | None = None, end: bytes | None = None, max_seq: int | None = None) -> DataFrame:
        return reads.scan(self.log(start, end), start, end, max_seq)

    def state(self, max_seq: int | None = None) -> DataFrame:
        return mvcc.visible(self.log(), max_seq)

    def create_views(self, prefix: str = "kv") -> None:
        """Temporary views <prefix>_log, <prefix>_current and <prefix>_runs, and the
        table function <prefix>_at(s): the live rows at sequence s."""
        self.log().createOrReplaceTempView(f"{prefix}_log")
        self.state().createOrReplaceTempView(f"{prefix}_current")
        self.manifest.to_frame(self.spark).createOrReplaceTempView(f"{prefix}_runs")
        self.spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_at(s BIGINT) RETURNS TABLE (key BINARY, seq BIGINT, value BINARY) RETURN "
            f"SELECT key, top.seq, top.value FROM (SELECT key, max(struct(seq, op, value)) AS top FROM {prefix}_log WHERE seq <= s GROUP BY key) WHERE top.op = 1"
        )

    def __len__(self) -> int:
        return self.state().count()


class Snapshot(View):
    """A view whose runs are kept until it is released, in any process."""

    def __init__(self, store: KVStore, manifest: man.Manifest):
        super().__init__(store.spark, store.path, manifest)
        self.sequence, self._folder = manifest.last_seq, store.folder
        self._pin = f"pin-{manifest.version:08d}-{uuid.uuid4().hex}"
        self._folder.create(self._pin, "")

    def release(self) -> None:
        self._folder.delete(self._pin)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *exc) -> None:
        self.release()


class KVStore:
    """Open with ``KVStore.open``; use as a context manager."""

    def __init__(self, spark: SparkSession, folder: man.Folder, options: Options):
        self.spark, self.folder, self.path, self.options = spark, folder, folder.path, options
        self._closed = False

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options = Options()) -> KVStore:
        options.validate()
        folder = man.Folder(spark, path)
        if folder.exists():
            if options.error_if_exists:
                raise AlreadyExists(path)
        elif not options.create_if_missing:
            raise NotFound(path)
        folder.make()
        return cls(spark, folder, options)

    @property
    def manifest(self) -> man.Manifest:
        if self._closed:
            raise Closed(self.path)
        return man.load(self.folder)

    # --- writes ---

    def put(self, key: bytes, value: bytes) -> int:
        return self.write(WriteBatch().put(key, value))

    def delete(self, key: bytes) -> int:
        return self.write(WriteBatch().delete(key))

    def write(self, batch: WriteBatch) -> int:
        """Apply a batch as one run; returns the last sequence."""
        return self.ingest(batch.to_frame(self.spark).withColumnRenamed("seq", "pos")) if len(batch) else self.manifest.last_seq

    def ingest(self, batch: DataFrame) -> int:
        """Write (pos, op, key, value) rows, numbered from 1, as one run; returns the last sequence."""
        rows = batch.select("key", F.col("pos").cast("long").alias("seq"), F.col("op").cast("byte").alias("op"), "value")
        run = self._write_run(rows, 0)
        if run is None:
            return self.manifest.last_seq

        def place(m: man.Manifest) -> man.Manifest:
            at = m.last_seq
            return m.adding(replace(run, base=at, min_seq=run.min_seq + at, max_seq=run.max_seq + at))

        done = self._commit(place)
        self.compact_if_due()
        return done.last_seq

    def ingest_stream_batch(self, rows: DataFrame, stream: str, batch_id: int) -> bool:
        """Write (key, seq, op, value) rows with sequences of their own, once for each
        batch of a stream; False if the batch is in the store already."""
        if self.manifest.batches.get(stream, -1) >= batch_id:
            return False
        run = self._write_run(rows.select("key", "seq", F.col("op").cast("byte").alias("op"), "value"), 0)

        def place(m: man.Manifest) -> man.Manifest:
            if m.batches.get(stream, -1) >= batch_id:
                return m
            m = replace(m, batches=m.batches | {stream: batch_id})
            return m.adding(run) if run else m

        self._commit(place)
        return True

    def _write_run(self, rows: DataFrame, level: int) -> man.Run | None:
        """Write a sorted run under a new name; nothing sees it before its commit."""
        name = uuid.uuid4().hex
        path = f"{self.path}/run={name}"
        writer = rows.select(*LOG.names).repartitionByRange(F.col("key")).sortWithinPartitions("key", F.col("seq").desc()).write.option("compression", PARQUET_CODEC[self.options.compression])
        if self.options.use_bloom_filter:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.options.bloom_filter_fp_rate))
        writer.parquet(path)
        s = self.spark.read.schema(LOG).parquet(path).agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
        if not s["n"]:
            self.folder.delete(f"run={name}")
            return None
        return man.Run(name, level, 0, s["n"], s["a"], s["b"], bytes(s["lo"]), bytes(s["hi"]))

    def _commit(self, change: Callable[[man.Manifest], man.Manifest]) -> man.Manifest:
        """Commit a change of the newest manifest, again if another writer was first."""
        for _ in range(TRIES):
            now = self.manifest
            new = change(now)
            if new is now:
                return now
            try:
                return man.commit(self.folder, new)
            except Busy:
                continue
        raise Busy(f"{TRIES} commits were overtaken by other writers")

    # --- compaction ---

    def compact_if_due(self) -> bool:
        """Merge the new runs, once they are many, with the old ones they overlap."""
        m = self.manifest
        fresh = [r for r in m.runs if r.level == 0]
        if len(fresh) < self.options.level0_compaction_threshold:
            return False
        low, high = min(r.smallest_key for r in fresh), max(r.largest_key for r in fresh)
        return self.compact(fresh + [r for r in m.runs if r.level and r.overlaps(low, high)])

    def compact(self, runs: list[man.Run] | None = None, keep: tuple[int, ...] = ()) -> bool:
        """Merge runs into one, with what is seen now and at the sequences ``keep``.

        Tombstones go only if no other run could hold the key, and never where
        streams bring rows with older sequences.  False if another writer has
        replaced one of the runs meanwhile; its result stands."""
        m = self.manifest
        runs = list(m.runs) if runs is None else runs
        if not runs:
            return False
        names = {r.name for r in runs}
        low, high = min(r.smallest_key for r in runs), max(r.largest_key for r in runs)
        alone = not m.batches and not any(r.overlaps(low, high) for r in m.runs if r.name not in names)
        merged = View(self.spark, self.path, m)._rows(runs)
        run = self._write_run(mvcc.retained(merged, list(keep), alone), 1)

        def place(now: man.Manifest) -> man.Manifest:
            if not names <= {r.name for r in now.runs}:
                return now
            kept = now.without(names)
            return kept.adding(run) if run else kept

        done = self._commit(place)
        return not names & {r.name for r in done.runs}

    def vacuum(self) -> list[str]:
        """Delete runs that only older versions need which no snapshot holds, and
        those versions; returns the runs' names.  Reads of an older version that
        are still to be run need a snapshot."""
        now = self.manifest
        pinned = {int(n.split("-")[1]) for n in self.folder.names() if n.startswith("pin-")} | {now.version}
        old = [v for v in man.versions(self.folder) if v < now.version]
        known = {v: {r.name for r in man.load(self.folder, v).runs} for v in [*old, now.version] if v}
        used = set().union(*(known.get(v, set()) for v in pinned))
        gone = sorted(set().union(*(known[v] for v in old)) - used)
        for name in gone:
            self.folder.delete(f"run={name}")
        for v in old:
            if v not in pinned:
                self.folder.delete(man.VERSION.format(v))
        return gone

    # --- reads ---

    def view(self) -> View:
        return View(self.spark, self.path, self.manifest)

    def log(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        return self.view().log(low, high)

    def get(self, key: bytes, max_seq: int | None = None) -> bytes | None:
        return self.view().get(key, max_seq)

    def multi_get(self, keys: DataFrame, max_seq: int | None = None) -> DataFrame:
        return self.view().multi_get(keys, max_seq)

    def scan(self, start: bytes | None = None, end: bytes | None = None, max_seq: int | None = None) -> DataFrame:
        return self.view().scan(start, end, max_seq)

    def state(self, max_seq: int | None = None) -> DataFrame:
        return self.view().state(max_seq)

    def create_views(self, prefix: str = "kv") -> None:
        self.view().create_views(prefix)

    def snapshot(self) -> Snapshot:
        while True:
            m = self.manifest
            snap = Snapshot(self, m)
            if not m.version or m.version in man.versions(self.folder):
                return snap
            snap.release()  # it was vacuumed meanwhile

    def __len__(self) -> int:
        return len(self.view())

    def close(self) -> None:
        self._closed = True

    def __enter__(self) -> KVStore:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def iterate(rows: DataFrame):
    """Live rows of a scan in order, fetched a partition at a time."""
    for r in rows.toLocalIterator():
        yield bytes(r["key"]), bytes(r["value"])
