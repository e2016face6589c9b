import random
import zlib

import pytest
from pyspark.sql import functions as F

from kvlake.functions import scalar
from kvlake.operators import bloom, cache, compaction, layout, mvcc, reads, wal
from kvlake.operators.batch import WriteBatch
from kvlake.options import Corruption, InvalidArgument, Options

LOG = "key binary, seq long, op byte, value binary"


def log_of(spark, rows):
    return spark.createDataFrame(rows, LOG)


def model(rows, at=None):
    state = {}
    for k, s, op, v in sorted(rows, key=lambda r: r[1]):
        if at is None or s <= at:
            if op:
                state[k] = v
            else:
                state.pop(k, None)
    return state


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for s in range(1, 400):
        k = bytes([rng.randrange(40)]) * rng.randrange(0, 3)
        out.append((k, s, 0, None) if rng.random() < 0.3 else (k, s, 1, b"" if rng.random() < 0.1 else str(s).encode()))
    return out


@pytest.mark.parametrize("at", [None, 1, 150, 399])
def test_visible_matches_a_dict(spark, rows, at):
    got = {bytes(r["key"]): bytes(r["value"]) for r in mvcc.visible(log_of(spark, rows), at).collect()}
    assert got == model(rows, at)


def test_fixed_width_values_use_a_hash_aggregate(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.5), (1, 2, 0, None), (2, 3, 1, 1.5)], "key long, seq long, op byte, value double")
    out = mvcc.visible(df)
    assert [(r["key"], r["value"]) for r in out.collect()] == [(2, 1.5)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Window" not in plan


def test_retained_keeps_what_snapshots_see(spark, rows):
    kept = [(bytes(r["key"]), r["seq"], r["op"], None if r["value"] is None else bytes(r["value"])) for r in mvcc.retained(log_of(spark, rows), [100, 250], True).collect()]
    for at in (100, 250, None):
        assert model(kept, at) == model(rows, at)
    assert len(kept) < len(rows)


def test_scan_seek_and_steps(spark, rows):
    log, live = log_of(spark, rows), sorted(model(rows))
    assert [bytes(r["key"]) for r in reads.scan(log, b"\x05", b"\x14").collect()] == [k for k in live if b"\x05" <= k < b"\x14"]
    target = b"\x10\x10\x10"
    assert bytes(reads.seek_one(log, target).first()["key"]) == min(k for k in live if k >= target)
    assert bytes(reads.prev_before(log, target).first()["key"]) == max(k for k in live if k < target)
    assert bytes(reads.next_after(log, target).first()["key"]) == min(k for k in live if k > target)
    targets = spark.createDataFrame([(bytes([b]),) for b in range(0, 256, 7)], "target binary")
    for r in reads.seek(log, targets).collect():
        want = min((k for k in live if k >= bytes(r["target"])), default=None)
        assert (None if r["key"] is None else bytes(r["key"])) == want
    for r in reads.seek_back(log, targets).collect():
        want = max((k for k in live if k <= bytes(r["target"])), default=None)
        assert (None if r["key"] is None else bytes(r["key"])) == want


def test_neighbours(spark, rows):
    live = sorted(model(rows))
    plain = lambda v: None if v is None else bytes(v)
    got = {bytes(r["key"]): (plain(r["prev_key"]), plain(r["next_key"])) for r in reads.neighbours(log_of(spark, rows)).collect()}
    assert got == {k: (a, b) for a, k, b in zip([None, *live], live, [*live[1:], None])}


def test_range_statistics(spark):
    log = spark.createDataFrame([(1, 1, 1, 5.0), (2, 2, 1, 7.0), (11, 3, 1, 1.0), (2, 4, 0, None), (1, 5, 1, 6.0)], "key long, seq long, op byte, value double")
    of = lambda **how: {r["prefix"]: tuple(r)[1:] for r in reads.range_stats(log, F.floor(F.col("key") / 10), **how).collect()}
    assert of() == {0: (1, 6.0, 6.0, 6.0), 1: (1, 1.0, 1.0, 1.0)}
    assert of(max_seq=3, end=11) == {0: (2, 12.0, 5.0, 7.0)}


def test_multi_get_and_diff(spark, rows):
    log = log_of(spark, rows)
    keys = spark.createDataFrame([(bytes([b]),) for b in range(50)], "key binary")
    got = {bytes(r["key"]): None if r["value"] is None else bytes(r["value"]) for r in reads.multi_get(log, keys).collect()}
    state = model(rows)
    assert got == {bytes([b]): state.get(bytes([b])) for b in range(50)}
    old, new = model(rows, 100), model(rows, 300)
    want = {k for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
    assert {bytes(r["key"]) for r in reads.diff(log, 100, 300).collect()} == want


def test_batch_counts_bytes_and_orders(spark):
    b = WriteBatch().put(b"a", b"12").delete(b"a").put(b"b", b"")
    assert (len(b), b.approximate_size()) == (3, 11 + 5 + 9)
    assert [r["seq"] for r in b.to_frame(spark, 10).collect()] == [11, 12, 13]
    assert model([tuple(r) for r in b.to_frame(spark).collect()]).keys() == {b"b"}
    b.clear()
    assert b.is_empty() and b.approximate_size() == 0


def test_pick_levels(spark):
    schema = "level int, file_number long, file_size long, smallest_key binary, largest_key binary"
    mb = 1 << 20

    def picked(files):
        return sorted((r["level"], r["file_number"], r["output_level"]) for r in compaction.pick(spark.createDataFrame(files, schema)).collect())

    assert picked([(0, i, 1, b"a", b"z") for i in range(2)]) == []
    assert picked([(0, i, 1, b"a", b"z") for i in range(4)]) == [(0, i, 1) for i in range(4)]
    assert picked([(1, i, 6 * mb, b"a", b"z") for i in (3, 2)]) == [(1, 2, 2)]
    assert picked([(0, i, 1, b"a", b"z") for i in range(4)] + [(1, 9, 60 * mb, b"a", b"z")])[0][0] == 0


def test_wal_round_trip_and_recovery(spark):
    data = [(0, b"x" * 10), (1, bytes(range(256)) * 400), (2, b""), (3, b"end")]
    frags = wal.frame(wal.fragment(spark.createDataFrame(data, "entry long, data binary")))
    assert [r["rtype"] for r in frags.where("entry = 1").orderBy("frag").collect()] == [2, 3, 3, 4]
    r = frags.where("entry = 0").first()
    assert r["crc"] == zlib.crc32(b"\x01" + b"x" * 10)
    back = {r["entry"]: bytes(r["data"]) for r in wal.reassemble(frags).collect()}
    assert back == {k: v for k, v in data if v}
    recs = frags.withColumn("log", F.lit(1)).withColumn("pos", F.col("entry") * 10 + F.col("frag"))
    bad = recs.withColumn("crc", F.when((F.col("entry") == 1) & (F.col("frag") == 2), F.col("crc") + 1).otherwise(F.col("crc")))
    assert {r["pos"] for r in wal.recover_prefix(bad).collect()} == {0}
    assert wal.recover_prefix(recs).count() == 6


def test_prefix_encoding_round_trips(spark):
    keys = sorted({f"k{a}{b}" for a in range(7) for b in ("", "x", "xy", "z" * 9)})
    rows = layout.blocks_by_rows(spark.createDataFrame([(k,) for k in keys], "key string"), 10)
    enc = layout.prefix_encode(rows, interval=4)
    assert sorted(r["key"] for r in layout.prefix_decode(enc).collect()) == keys
    assert enc.where("is_restart and shared > 0").count() == 0
    index = layout.block_index(rows)
    found = layout.find_block(index, spark.createDataFrame([("k3",), ("zzz",)], "target string")).collect()
    assert {r["target"]: r["block"] for r in found}["zzz"] == (len(keys) - 1) // 10


def test_bloom_filter():
    keys = [f"user/{i * 37 % 3001}".encode() for i in range(3000)]
    f = bloom.BloomFilter.sized(len(keys)).add(keys)
    assert f.may_contain(keys).all()
    assert f.may_contain([f"absent_{i}".encode() for i in range(3000)]).mean() < 0.03
    again = bloom.BloomFilter.decode(f.encode())
    assert (again.bits == f.bits).all() and again.hashes == f.hashes
    assert not bloom.BloomFilter.sized(0).may_contain([b"a"]).any()
    with pytest.raises(Corruption):
        bloom.BloomFilter.decode(f.encode()[:-1])


def test_stack_distance_tells_what_a_cache_hits(spark):
    rng = random.Random(1)
    acc = [(i % 2, i, rng.randrange(8)) for i in range(400)]
    dist = cache.stack_distance(spark.createDataFrame(acc, "shard long, access_id long, block long"))
    hits, held = {0: 0, 1: 0}, {0: [], 1: []}
    for shard, _, b in acc:  # a cache of four blocks, the one used last in front
        hits[shard] += b in held[shard]
        held[shard] = [b, *(x for x in held[shard] if x != b)][:4]
    assert {r["shard"]: r["hits"] for r in cache.hits_by_shard(dist, 4).collect()} == hits
    assert cache.cache_stats(dist, 4).first()["hits"] == sum(hits.values())


def test_stack_distance_of_one_long_shard(spark):
    rng = random.Random(2)
    acc = [("b" if i % 3 else "a", 7 * i, rng.choice([None, 0, *range(1, 400)]) if i % 5 else 0) for i in range(3000)]
    dealt = spark.createDataFrame(rng.sample(acc, len(acc)), "shard string, access_id long, block long")
    out = cache.stack_distance(dealt)
    want = {}
    for shard in "ab":
        recent = []
        for _, i, b in (a for a in acc if a[0] == shard):
            want[i] = recent.index(b) if b in recent else None
            recent = [b, *(x for x in recent if x != b)]
    assert {r["access_id"]: r["distance"] for r in out.collect()} == want
    # no pairs of accesses by range: every join has an equal key and no other condition
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan and not [x for x in plan.split("\n") if "Join" in x and (" < " in x or " > " in x)]


def test_options():
    with pytest.raises(InvalidArgument):
        Options().with_(max_levels=1)
    with pytest.raises(InvalidArgument):
        Options().with_(bloom_filter_fp_rate=1.0)
    assert [Options().target_size(n) for n in (1, 2, 3)] == [10 << 20, 100 << 20, 1000 << 20]
    assert all(o.validate() for o in (Options.for_testing(), Options.for_high_read_throughput(), Options.for_high_write_throughput()))


def test_scalars(spark):
    df = spark.createDataFrame([(b"k\xff", 7, 1)], "key binary, seq long, op byte")
    raw = df.select(scalar.encode_internal_key(F.col("key"), F.col("seq"), F.col("op")).alias("r"))
    assert bytes(raw.first()["r"]) == b"k\xff" + (7).to_bytes(8, "little") + b"\x01"
    assert raw.select(scalar.decode_internal_key(F.substring("r", 1, 5)).alias("d")).first()["d"] is None
