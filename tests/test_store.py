import pytest

from kvlake.operators.batch import WriteBatch
from kvlake.options import AlreadyExists, Busy, Closed, NotFound, Options
from kvlake.sources import manifest as man
from kvlake.sources.store import KVStore, iterate
from kvlake.streaming import ingest

OPTS = Options.for_testing().with_(level0_compaction_threshold=4)
ROWS = "key binary, seq long, op byte, value binary"


def items(df):
    return list(iterate(df))


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "db")


def test_open_rules(spark, tmp_path):
    with pytest.raises(NotFound):
        KVStore.open(spark, str(tmp_path / "no"), OPTS.with_(create_if_missing=False))
    with pytest.raises(AlreadyExists):
        KVStore.open(spark, str(tmp_path), OPTS.with_(error_if_exists=True))


def test_put_delete_reopen(spark, path):
    with KVStore.open(spark, path, OPTS) as db:
        assert db.write(WriteBatch().put(b"key0", b"v0").put(b"key1", b"v1").put(b"", b"empty key").put(b"e", b"")) == 4
        assert db.delete(b"key1") == 5
        assert (db.get(b"key0"), db.get(b"key1"), db.get(b"e"), db.get(b"")) == (b"v0", None, b"", b"empty key")
        assert db.get(b"key1", 4) == b"v1"
        assert db.write(WriteBatch()) == 5
    with pytest.raises(Closed):
        db.get(b"e")
    with KVStore.open(spark, path, OPTS) as db:
        # a tombstone in a newer run hides the value in an older one
        assert db.get(b"key1") is None and db.get(b"key0") == b"v0"
        db.put(b"key1", b"back")
        assert len(db.manifest.runs) == 3
        assert [k for k, _ in items(db.scan(b"key"))] == [b"key0", b"key1"]


def test_newest_of_several_runs_and_compaction(spark, path):
    with KVStore.open(spark, path, OPTS) as db:
        for v in range(5):
            db.write(WriteBatch().put(b"k", b"%d" % v).put(b"only%d" % v, b"x"))
            assert db.get(b"k") == b"%d" % v
        assert len([r for r in db.manifest.runs if r.level == 0]) < 4
        db.delete(b"k")
        db.compact()
        assert db.get(b"k") is None and len(db) == 5
        assert sum(r.rows for r in db.manifest.runs) == 5
        db.vacuum()
        assert len(db) == 5 and sum(n.startswith("run=") for n in db.folder.names()) == 1


def test_snapshot_survives_compaction_and_vacuum(spark, path):
    with KVStore.open(spark, path, OPTS) as db:
        db.write(WriteBatch().put(b"k1", b"v1").put(b"k2", b"v2"))
        snap = db.snapshot()
        later = snap.scan()  # read only after its runs were replaced
        db.write(WriteBatch().put(b"k1", b"new").delete(b"k2").put(b"k3", b"v3"))
        assert db.compact() and db.vacuum() != []
        assert (snap.get(b"k1"), snap.get(b"k2"), snap.get(b"k3")) == (b"v1", b"v2", None)
        assert [k for k, _ in items(later)] == [b"k1", b"k2"]
        assert (db.get(b"k1"), db.get(b"k2")) == (b"new", None)
        snap.release()
        db.vacuum()
        assert sum(n.startswith("run=") for n in db.folder.names()) == 1
        assert sum(r.rows for r in db.manifest.runs) == 2


def test_compaction_keeps_asked_sequences(spark, path):
    with KVStore.open(spark, path, OPTS) as db:
        for v in (b"1", b"2", b"3"):
            db.put(b"k", v)
        db.compact(keep=(2,))
        assert (db.get(b"k", 2), db.get(b"k")) == (b"2", b"3")


def test_commits_conflict(spark, tmp_path):
    folder = man.Folder(spark, str(tmp_path))
    m = man.load(folder)
    man.commit(folder, m)
    with pytest.raises(Busy):
        man.commit(folder, m)


def test_two_writers_lose_nothing(spark, path):
    """A writer that meets another's commit takes the next sequences."""
    a, b = KVStore.open(spark, path, OPTS), KVStore.open(spark, path, OPTS)
    seen = man.load

    def stale(folder, version=None, turns=[0]):
        turns[0] += 1
        m = seen(folder, version)
        if turns[0] == 1:  # between b's look and its commit, a commits
            a.put(b"a", b"of a")
        return m

    run = b._write_run(WriteBatch().put(b"b", b"of b").to_frame(spark), 0)
    try:
        man.load = stale
        b._commit(lambda m: m.adding(man.replace(run, base=m.last_seq, min_seq=m.last_seq + 1, max_seq=m.last_seq + 1)))
    finally:
        man.load = seen
    for db in (a, b, KVStore.open(spark, path, OPTS)):
        assert (db.get(b"a"), db.get(b"b")) == (b"of a", b"of b")
    assert sorted(r["seq"] for r in a.log().collect()) == [1, 2]


def test_a_failed_writer_leaves_nothing_that_is_seen(spark, path):
    with KVStore.open(spark, path, OPTS) as db:
        db.put(b"a", b"1")
        db._write_run(WriteBatch().put(b"a", b"lost").to_frame(spark), 0)  # never committed
        db.folder._fs.create(db.folder._at(".manifest-00000002.json.half")).close()
        assert db.get(b"a") == b"1"
        db.put(b"a", b"2")
        assert db.get(b"a") == b"2"


def test_compaction_that_was_overtaken_changes_nothing(spark, path):
    with KVStore.open(spark, path, OPTS) as db:
        db.put(b"a", b"1")
        db.put(b"b", b"2")
        old = list(db.manifest.runs)
        db.compact()
        after = db.manifest
        own = db._commit
        assert db.compact(old) is True or db.manifest == after  # its inputs are gone
        assert db._commit == own and db.manifest == after
        assert {k for k, _ in items(db.scan())} == {b"a", b"b"}


def test_ingest_and_sql(spark, path):
    with KVStore.open(spark, path, OPTS) as db:
        rows = spark.createDataFrame([(b"a", 1, 1, b"1"), (b"a", 2, 1, b"2"), (b"b", 3, 0, None)], "key binary, pos long, op byte, value binary")
        assert db.ingest(rows) == 3
        assert db.ingest(rows.where("false")) == 3
        db.put(b"b", b"later")
        db.create_views()
        assert spark.sql("select count(*) n from kv_current").first()["n"] == 2
        at = lambda s: {bytes(r["key"]): bytes(r["value"]) for r in spark.sql(f"select * from kv_at({s})").collect()}
        assert (at(1), at(3), at(4)) == ({b"a": b"1"}, {b"a": b"2"}, {b"a": b"2", b"b": b"later"})


def stream_of(spark, folder, rows, part):
    spark.createDataFrame(rows, ROWS).write.parquet(f"{folder}/{part}")
    return spark.readStream.schema(ROWS).parquet(f"{folder}/*")


def run(query):
    query = query.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_streams_and_puts_share_a_store(spark, tmp_path, path):
    first = stream_of(spark, tmp_path / "in", [(b"a", 1, 1, b"1"), (b"b", 2, 1, b"2"), (b"a", 3, 0, None)], "p1")
    with KVStore.open(spark, path, OPTS) as db:
        db.put(b"p", b"put before")
        run(ingest.to_store(first, db, str(tmp_path / "cp1")))
        assert items(db.scan()) == [(b"b", b"2"), (b"p", b"put before")]
        # a batch that comes again is in the store already
        assert not db.ingest_stream_batch(spark.createDataFrame([(b"x", 9, 1, b"9")], ROWS), str(tmp_path / "cp1"), 0)
        # another stream starts at batch 0 too
        second = stream_of(spark, tmp_path / "in2", [(b"c", 10, 1, b"3")], "p1")
        run(ingest.to_store(second, db, str(tmp_path / "cp2")))
        db.put(b"q", b"put after")
        assert [k for k, _ in items(db.scan())] == [b"b", b"c", b"p", b"q"]
    with KVStore.open(spark, path, OPTS) as db:
        assert (db.get(b"p"), db.get(b"q")) == (b"put before", b"put after")


def test_latest_of_a_stream(spark, tmp_path):
    stream = stream_of(spark, tmp_path / "in", [(b"a", 1, 1, b"1"), (b"b", 2, 1, b"2"), (b"a", 3, 0, None)], "p1")
    run(ingest.latest(stream).writeStream.format("memory").queryName("latest_keys").outputMode("complete"))
    assert {(bytes(r["key"]), r["op"]) for r in spark.sql("select key, op from latest_keys").collect()} == {(b"a", 0), (b"b", 1)}
