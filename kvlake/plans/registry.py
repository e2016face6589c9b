"""Queries over the given tables, one for each operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvlake.functions import scalar
from kvlake.operators import batch, bloom, cache, compaction, layout, mvcc, ranges, reads, wal
from kvlake.options import Options
from kvlake.sources import oplog as src

FRAGMENT = 4096
KEYS_PER_FILTER = 5000
OPT = Options()

QUERIES = {}
ORACLE_SQL = {}

# Views that the SQL of the queries shares.
_LOG = """log AS (SELECT user_id AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op,
  CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"""
_TEXT = """log AS (SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') || ':' || event_type AS key, event_id + 1 AS seq,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op, CASE WHEN event_type <> 'error' THEN props END AS value FROM events)"""
_RUNS = _LOG + """, runs AS (SELECT *, CAST((seq // 64) % 4 AS INTEGER) AS run, CAST(3 - (seq // 64) % 4 AS INTEGER) AS prio FROM log)"""
_FILES = """edits AS (
  SELECT o_orderkey * 2 AS edit_pos, 'AddFile' AS kind, CAST(o_custkey % 4 AS INTEGER) AS level, o_orderkey AS file_number, CAST(floor(o_totalprice) AS BIGINT) AS file_size,
    o_orderkey AS smallest_key, o_orderkey + o_custkey % 50 AS largest_key FROM orders
  UNION ALL SELECT o_orderkey * 2 + 5, 'DeleteFile', CAST(o_custkey % 4 AS INTEGER), o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 3 = 0),
files AS (SELECT level, file_number, file_size, smallest_key, largest_key FROM edits a WHERE kind = 'AddFile'
  AND NOT EXISTS (SELECT 1 FROM edits d WHERE d.kind = 'DeleteFile' AND d.level = a.level AND d.file_number = a.file_number AND d.edit_pos > a.edit_pos))"""
_ORDERS = "keys AS (SELECT 'order:' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS key, o_orderkey, o_totalprice AS value FROM orders)"
_BLOCKS = _ORDERS + ", blocks AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS pos, (row_number() OVER (ORDER BY key) - 1) // 100 AS block FROM keys)"


def _live(bound: str = "", name: str = "live", where: str = "") -> str:
    tests = " AND ".join(x for x in (bound, where) if x)
    return f"{name} AS (SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log {'WHERE ' + tests if tests else ''}) WHERE r = 1 AND op = 1)"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _out(df):
    return df.select("key", "seq", "value")


# --- Latest state, lookups, snapshots -----------------------------------------------------


@query(f"WITH {_LOG}, {_live()} SELECT * FROM live")
def current_state(spark, sf):
    return _out(mvcc.visible(src.oplog(spark, sf)))


@query(f"WITH {_LOG}, {_live(where='key = 7')} SELECT * FROM live")
def get_point(spark, sf):
    return _out(reads.get(src.oplog(spark, sf), 7))


@query(f"WITH {_LOG}, {_live(where='key = -1')} SELECT * FROM live")
def get_missing(spark, sf):
    return _out(reads.get(src.oplog(spark, sf), -1))


_GONE = "(SELECT max(key) AS k FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log) WHERE r = 1 AND op = 0)"


@query(f"WITH {_LOG}, gone AS {_GONE} SELECT g.k AS key, l.op IS NOT NULL AND l.op = 1 AS found FROM gone g LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log) l ON l.key = g.k AND l.r = 1")
def get_deleted(spark, sf):
    log = src.oplog(spark, sf)
    key = mvcc.newest(log).where("op = 0").agg(F.max("key").alias("key"))
    return reads.multi_get(log, key).select("key", F.col("seq").isNotNull().alias("found"))


@query(f"WITH {_LOG}, {_live()}, wanted AS (SELECT DISTINCT c_custkey AS key FROM customer) SELECT w.key, l.seq, l.value FROM wanted w LEFT JOIN live l ON l.key = w.key")
def multi_get(spark, sf):
    wanted = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("key")).distinct()
    return _out(reads.multi_get(src.oplog(spark, sf), wanted))


def _at(log, tenths: int) -> int:
    """A sequence so many tenths along the log."""
    return log.agg(F.max("seq")).first()[0] * tenths // 10


def _seq(tenths: int) -> str:
    return f"(SELECT max(seq) * {tenths} // 10 FROM log)"


@query(f"WITH {_LOG}, {_live(f'seq <= {_seq(5)}', where='key = 5')} SELECT * FROM live")
def snapshot_get(spark, sf):
    log = src.oplog(spark, sf)
    return _out(reads.get(log, 5, _at(log, 5)))


@query(f"WITH {_LOG}, {_live(f'seq <= {_seq(5)}')} SELECT * FROM live")
def snapshot_scan(spark, sf):
    log = src.oplog(spark, sf)
    return _out(reads.scan(log, max_seq=_at(log, 5)))


@query(
    f"WITH {_LOG}, {_live(f'seq <= {_seq(5)}', 'a')}, {_live(f'seq <= {_seq(9)}', 'b')} SELECT coalesce(a.key, b.key) AS key, a.value AS old_value, b.value AS new_value, "
    "CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.key = b.key "
    "WHERE a.key IS NULL OR b.key IS NULL OR a.value IS DISTINCT FROM b.value"
)
def snapshot_diff(spark, sf):
    log = src.oplog(spark, sf)
    return reads.diff(log, _at(log, 5), _at(log, 9))


@query(f"WITH {_LOG} SELECT max(seq) AS sequence FROM log")
def snapshot_sequence(spark, sf):
    return src.oplog(spark, sf).agg(F.max("seq").alias("sequence"))


# --- Writes -----------------------------------------------------------------------------------


@query(f"WITH {_LOG} SELECT key, seq, op, value FROM log")
def oplog_encode(spark, sf):
    return src.oplog(spark, sf)


_BATCH = """batch AS (SELECT c_custkey AS key, CAST(c_custkey AS BIGINT) + 1 AS pos, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END AS op,
  CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS value FROM customer)"""


def _customer_batch(spark, sf):
    c = src.table(spark, sf, "customer")
    op = F.when(F.col("c_custkey") % 4 == 0, 0).otherwise(1).cast("byte")
    return c.select(F.col("c_custkey").alias("key"), (F.col("c_custkey") + 1).cast("long").alias("pos"), op.alias("op"), F.when(op == 1, F.col("c_acctbal")).alias("value"))


@query(f"WITH events_log AS (SELECT 1), {_LOG.replace('log AS', 'base AS')}, {_BATCH}, log AS (SELECT * FROM base UNION ALL SELECT key, (SELECT max(seq) FROM base) + pos, op, value FROM batch), {_live()} SELECT * FROM live")
def write_batch_apply(spark, sf):
    log = src.oplog(spark, sf)
    top = log.agg(F.max("seq").alias("_top"))
    rows = _customer_batch(spark, sf).join(top, F.lit(True))  # one row
    return _out(mvcc.visible(batch.apply_batch(log, rows, F.col("_top"))))


@query(f"WITH {_TEXT} SELECT CAST(count(*) AS BIGINT) AS n_ops, CAST(sum(length(key) + CASE WHEN op = 1 THEN length(value) + 8 ELSE 4 END) AS BIGINT) AS approximate_size FROM log")
def write_batch_size(spark, sf):
    return batch.batch_size(src.text_log(spark, sf))


# --- Ordered scans and cursors ----------------------------------------------------------------


@query(f"WITH {_LOG}, {_live()} SELECT * FROM live")
def iter_all(spark, sf):
    return _out(reads.scan(src.oplog(spark, sf)))


@query(f"WITH {_LOG}, {_live(where='key >= 3 AND key < 9')} SELECT * FROM live")
def scan_range(spark, sf):
    return _out(reads.scan(src.oplog(spark, sf), 3, 9))


@query(f"WITH {_LOG}, {_live(where='key >= 8')} SELECT * FROM live")
def scan_from(spark, sf):
    return _out(reads.scan(src.oplog(spark, sf), start=8))


@query(f"WITH {_LOG}, {_live(where='key < 8')} SELECT * FROM live")
def scan_until(spark, sf):
    return _out(reads.scan(src.oplog(spark, sf), end=8))


@query(f"WITH {_TEXT}, {_live()} SELECT * FROM live WHERE starts_with(key, 'user:00000')")
def prefix_scan(spark, sf):
    return _out(reads.prefix_scan(src.text_log(spark, sf), "user:00000"))


@query(f"WITH {_TEXT}, {_live()} SELECT substr(key, 1, 10) AS prefix, count(*) AS n_keys FROM live GROUP BY 1")
def prefix_count(spark, sf):
    return reads.prefix_count(src.text_log(spark, sf), F.substring("key", 1, 10))


@query(f"WITH {_TEXT}, {_live()}, t AS (SELECT DISTINCT 'user:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS target FROM customer) SELECT t.target, min(l.key) AS key FROM t LEFT JOIN live l ON l.key >= t.target GROUP BY t.target")
def seek_ge(spark, sf):
    targets = src.table(spark, sf, "customer").select(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("target")).distinct()
    return reads.seek(src.text_log(spark, sf), targets)


@query(f"WITH {_TEXT}, {_live()}, t AS (SELECT DISTINCT 'user:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS target FROM customer) SELECT t.target, max(l.key) AS key FROM t LEFT JOIN live l ON l.key <= t.target GROUP BY t.target")
def seek_le(spark, sf):
    targets = src.table(spark, sf, "customer").select(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("target")).distinct()
    return reads.seek_back(src.text_log(spark, sf), targets)


@query(f"WITH {_LOG}, {_live(f'seq <= {_seq(7)}')} SELECT key // 10 AS prefix, count(*) AS n_keys, CAST(sum(CAST(value AS DECIMAL(20, 2))) AS DOUBLE) AS total, min(value) AS least, max(value) AS greatest FROM live GROUP BY 1")
def range_statistics(spark, sf):
    log = src.oplog(spark, sf)
    rows = log.withColumn("cents", F.col("value").cast("decimal(20,2)"))  # sums of decimals do not depend on their order
    out = reads.range_stats(rows, F.floor(F.col("key") / 10), "cents", max_seq=_at(log, 7))
    return out.select("prefix", "n_keys", F.col("total").cast("double").alias("total"), F.col("least").cast("double").alias("least"), F.col("greatest").cast("double").alias("greatest"))


@query(f"WITH {_LOG}, {_live()} SELECT * FROM live ORDER BY key LIMIT 1")
def seek_first(spark, sf):
    return _out(reads.first(src.oplog(spark, sf)))


@query(f"WITH {_LOG}, {_live()} SELECT * FROM live ORDER BY key DESC LIMIT 1")
def seek_last(spark, sf):
    return _out(reads.last(src.oplog(spark, sf)))


@query(f"WITH {_TEXT}, {_live()} SELECT key, lead(key) OVER (ORDER BY key) AS next_key FROM live")
def iter_next(spark, sf):
    return reads.neighbours(src.text_log(spark, sf)).select("key", "next_key")


@query(f"WITH {_TEXT}, {_live()} SELECT key, lag(key) OVER (ORDER BY key) AS prev_key FROM live")
def iter_prev(spark, sf):
    return reads.neighbours(src.text_log(spark, sf)).select("key", "prev_key")


@query(f"WITH {_TEXT}, {_live()} SELECT * FROM live WHERE key > 'user:000003' ORDER BY key LIMIT 20")
def page_keyset(spark, sf):
    return _out(reads.page(src.text_log(spark, sf), "user:000003", 20))


@query(f"WITH {_LOG}, {_live(where='key > 5')} SELECT * FROM live ORDER BY key LIMIT 1")
def next_after_key(spark, sf):
    return _out(reads.next_after(src.oplog(spark, sf), 5))


@query(f"WITH {_LOG}, {_live(where='key < 5')} SELECT * FROM live ORDER BY key DESC LIMIT 1")
def prev_before_key(spark, sf):
    return _out(reads.prev_before(src.oplog(spark, sf), 5))


@query(f"WITH {_LOG} SELECT * FROM log")
def version_history(spark, sf):
    return mvcc.history(src.oplog(spark, sf))


@query(f"WITH {_LOG} SELECT key, count(*) AS n_versions, CAST(sum(1 - op) AS BIGINT) AS n_tombstones FROM log GROUP BY key")
def version_count(spark, sf):
    return src.oplog(spark, sf).groupBy("key").agg(F.count("*").alias("n_versions"), F.sum(1 - F.col("op").cast("long")).alias("n_tombstones"))


@query(f"WITH {_TEXT} SELECT count(*) AS n_entries, CAST(sum(length(key) + coalesce(length(value), 0) + 16) AS BIGINT) AS approximate_size, min(seq) AS start_seq, max(seq) AS last_seq FROM log")
def memtable_stats(spark, sf):
    return reads.log_stats(src.text_log(spark, sf))


@query(f"WITH {_TEXT} SELECT DISTINCT key FROM log")
def memtable_keys(spark, sf):
    return reads.keys(src.text_log(spark, sf))


@query(f"WITH {_LOG} SELECT key, seq, op, row_number() OVER (PARTITION BY key ORDER BY seq DESC, op DESC) AS version FROM log")
def internal_key_order(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy(F.col("seq").desc(), F.col("op").desc())
    return src.oplog(spark, sf).select("key", "seq", "op", F.row_number().over(w).cast("long").alias("version"))


@query(f"WITH {_TEXT} SELECT key, seq, op, true AS roundtrip, length(key) + 9 AS encoded_length FROM log")
def internal_key_codec(spark, sf):
    log = src.text_log(spark, sf)
    coded = log.withColumn("raw", scalar.encode_internal_key(F.col("key").cast("binary"), F.col("seq"), F.col("op")))
    back = coded.withColumn("d", scalar.decode_internal_key(F.col("raw")))
    same = (F.col("d.key") == F.col("key").cast("binary")) & (F.col("d.seq") == F.col("seq")) & (F.col("d.op") == F.col("op"))
    return back.select("key", "seq", "op", same.alias("roundtrip"), F.length("raw").cast("long").alias("encoded_length"))


# --- Runs, compaction, manifest ---------------------------------------------------------------


@query(f"WITH {_RUNS} SELECT run, key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) AS r FROM runs) WHERE r = 1")
def flush_runs(spark, sf):
    return compaction.flush(src.runs(spark, sf).drop("prio")).select("run", "key", "seq", "op", "value")


@query(f"WITH {_RUNS} SELECT run, min(key) AS smallest_key, max(key) AS largest_key, count(*) AS n_entries, min(seq) AS min_seq, max(seq) AS max_seq FROM runs GROUP BY run")
def run_bounds(spark, sf):
    return compaction.run_bounds(src.runs(spark, sf))


_FLUSHED = ", flushed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) AS r FROM runs) WHERE r = 1)"


@query(f"WITH {_RUNS}{_FLUSHED} SELECT key, prio, seq, op FROM flushed")
def merge_runs(spark, sf):
    return compaction.merge(compaction.flush(src.runs(spark, sf))).select("key", "prio", "seq", "op")


@query(f"WITH {_RUNS}{_FLUSHED} SELECT key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio) AS q FROM flushed) WHERE q = 1")
def compact_l0_to_l0(spark, sf):
    return compaction.compact(compaction.flush(src.runs(spark, sf))).select("key", "seq", "op", "value")


@query(f"WITH {_RUNS}{_FLUSHED} SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio) AS q FROM flushed) WHERE q = 1 AND op = 1")
def compact_to_l1(spark, sf):
    return _out(compaction.compact(compaction.flush(src.runs(spark, sf)), drop_tombstones=True))


@query(
    f"WITH {_LOG}, n AS (SELECT *, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS nx FROM log), t AS (SELECT {_seq(3)} AS a, {_seq(7)} AS b), kept AS (SELECT n.* FROM n, t WHERE nx IS NULL OR (seq <= a AND nx > a) OR (seq <= b AND nx > b)), "
        "p AS (SELECT *, sum(op) OVER (PARTITION BY key ORDER BY seq) AS puts FROM kept) SELECT key, seq, op FROM p WHERE puts > 0"
)
def compact_with_snapshots(spark, sf):
    log = src.oplog(spark, sf)
    return mvcc.retained(log, [_at(log, 3), _at(log, 7)], drop_tombstones=True).select("key", "seq", "op")


@query(f"WITH {_FILES} SELECT level, count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS total_size, CASE WHEN level > 0 THEN CAST(10485760 * pow(10, level - 1) AS BIGINT) END AS target_size FROM files GROUP BY level")
def level_sizes(spark, sf):
    return compaction.level_sizes(compaction.replay(src.edits(spark, sf)))


@query(
    f"WITH {_FILES}, s AS (SELECT level, count(*) AS n, sum(file_size) AS t FROM files GROUP BY level), d AS (SELECT min(level) AS level FROM s WHERE (level = 0 AND n >= 4) OR (level BETWEEN 1 AND 5 AND t > 10485760 * pow(10, level - 1))) "
    "SELECT level, file_number, CAST(level + 1 AS INTEGER) AS output_level FROM (SELECT f.level, f.file_number, row_number() OVER (ORDER BY f.file_number) AS r FROM files f JOIN d ON d.level = f.level) WHERE level = 0 OR r = 1"
)
def pick_compaction(spark, sf):
    return compaction.pick(compaction.replay(src.edits(spark, sf))).select("level", "file_number", "output_level")


@query(
    f"WITH {_FILES}, i AS (SELECT min(smallest_key) AS lo, max(largest_key) AS hi FROM files WHERE level = 0) SELECT level, file_number FROM files, i WHERE level = 1 AND smallest_key <= hi AND largest_key >= lo"
)
def overlapping_files(spark, sf):
    files = compaction.replay(src.edits(spark, sf))
    inputs = files.where("level = 0").withColumn("output_level", F.col("level") + 1)
    return compaction.overlapping(files, inputs).select("level", "file_number")


@query(f"WITH {_FILES} SELECT * FROM files")
def manifest_replay(spark, sf):
    return compaction.replay(src.edits(spark, sf))


@query(f"WITH {_FILES} SELECT count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS total_size FROM files")
def manifest_totals(spark, sf):
    return compaction.totals(compaction.replay(src.edits(spark, sf)))


# --- Log framing --------------------------------------------------------------------------------

_FRAG = """doc AS (SELECT doc_id AS entry, encode(coalesce(text, '')) AS data FROM documents),
frag AS (SELECT entry, CAST(f AS INTEGER) AS frag, CAST(CASE WHEN n = 1 THEN 1 WHEN f = 0 THEN 2 WHEN f = n - 1 THEN 4 ELSE 3 END AS INTEGER) AS rtype,
  least(4096, octet_length(data) - f * 4096) AS len FROM (SELECT entry, data, n, unnest(range(0, n)) AS f FROM (SELECT *, CAST(ceil(octet_length(data) / 4096.0) AS BIGINT) AS n FROM doc WHERE octet_length(data) > 0)))"""


@query(f"WITH {_FRAG} SELECT entry, frag, rtype, CAST(len AS BIGINT) AS len FROM frag")
def wal_fragment(spark, sf):
    out = wal.fragment(src.payloads(spark, sf), limit=FRAGMENT)
    return out.select("entry", "frag", F.col("rtype").cast("int").alias("rtype"), F.col("len").cast("long").alias("len"))


@query("SELECT doc_id AS entry, sha256(text) AS digest, CAST(ceil(octet_length(encode(text)) / 4096.0) AS BIGINT) AS n_records FROM documents WHERE length(text) > 0")
def wal_reassemble(spark, sf):
    out = wal.reassemble(wal.fragment(src.payloads(spark, sf), limit=FRAGMENT))
    return out.select("entry", F.sha2("data", 256).alias("digest"), "n_records")


def _records(spark, sf):
    """Framed records, a log for every 64 documents; a record in 97 is damaged."""
    r = wal.frame(wal.fragment(src.payloads(spark, sf), limit=FRAGMENT))
    r = r.withColumn("log", F.floor(F.col("entry") / 64).cast("long")).withColumn("pos", F.col("entry") * 1000 + F.col("frag"))
    return r.withColumn("crc", F.when(F.col("entry") % 97 == 96, F.col("crc") + 1).otherwise(F.col("crc")))


@query(
    f"WITH {_FRAG}, rec AS (SELECT entry // 64 AS log, entry * 1000 + frag AS pos, entry % 97 = 96 AS bad FROM frag), b AS (SELECT log, min(pos) AS p FROM rec WHERE bad GROUP BY log) "
    "SELECT r.log, r.pos FROM rec r LEFT JOIN b ON b.log = r.log WHERE b.p IS NULL OR r.pos < b.p"
)
def wal_recover_prefix(spark, sf):
    return wal.recover_prefix(_records(spark, sf)).select("log", "pos")


@query(
    f"WITH {_FRAG}, rec AS (SELECT entry // 64 AS log, entry * 1000 + frag AS pos, len FROM frag) "
    "SELECT log, pos, CAST(coalesce(sum(len + 7) OVER (PARTITION BY log ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM rec"
)
def wal_offsets(spark, sf):
    return wal.offsets(_records(spark, sf)).select("log", "pos", "offset")


@query()
def wal_crc(spark, sf):
    return wal.frame(wal.fragment(src.payloads(spark, sf), limit=FRAGMENT)).select("entry", "frag", "crc", F.hex("header").alias("header"))


@query(f"WITH {_TEXT} SELECT key, seq, op, value, true AS roundtrip FROM log")
def wal_payload_codec(spark, sf):
    log = src.text_log(spark, sf)
    raw = wal.payload(F.col("op"), F.col("key").cast("binary"), F.col("value").cast("binary"))
    d = log.withColumn("d", wal.parse_payload(raw))
    same = (F.col("d.key").cast("string") == F.col("key")) & (F.col("d.op") == F.col("op")) & F.col("d.value").cast("string").eqNullSafe(F.col("value"))
    return d.select("key", "seq", "op", "value", same.alias("roundtrip"))


@query("SELECT o_orderkey AS number, lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') || '.log' AS name, o_orderkey AS back FROM orders")
def wal_names(spark, sf):
    o = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("number")).withColumn("name", wal.log_name(F.col("number")))
    return o.withColumn("back", wal.log_number(F.col("name")))


# --- Sorted blocks ------------------------------------------------------------------------------


def _blocks(spark, sf):
    return layout.blocks_by_rows(src.order_keys(spark, sf), 100)


@query(f"WITH {_BLOCKS} SELECT key, block, (pos % 100) % 16 = 0 AS is_restart FROM blocks")
def block_restarts(spark, sf):
    return layout.prefix_encode(_blocks(spark, sf)).select("key", "block", "is_restart")


_SHARED = """, p AS (SELECT key, block, pos % 100 AS entry, lag(key) OVER (PARTITION BY block ORDER BY key) AS prev FROM blocks),
s AS (SELECT key, block, entry, CASE WHEN entry % 16 = 0 THEN 0 ELSE coalesce((SELECT max(i) FROM (SELECT unnest(range(0, 15)) AS i) WHERE substr(p.key, 1, i) = substr(p.prev, 1, i)), 0) END AS shared FROM p)"""


@query(f"WITH {_BLOCKS}{_SHARED} SELECT key, block, CAST(entry AS BIGINT) AS entry, CAST(least(shared, 14) AS BIGINT) AS shared FROM s")
def shared_prefix(spark, sf):
    return layout.prefix_encode(_blocks(spark, sf)).select("key", "block", "entry", "shared")


@query(f"WITH {_BLOCKS} SELECT block, pos % 100 AS entry, key FROM blocks")
def prefix_roundtrip(spark, sf):
    return layout.prefix_decode(layout.prefix_encode(_blocks(spark, sf))).select("block", "entry", "key")


@query(f"WITH {_BLOCKS} SELECT block, max(key) AS last_key, count(*) AS n_entries FROM blocks GROUP BY block")
def block_index(spark, sf):
    return layout.block_index(_blocks(spark, sf))


@query(
    f"WITH {_BLOCKS}, ix AS (SELECT block, max(key) AS last_key FROM blocks GROUP BY block), t AS (SELECT DISTINCT 'order:' || lpad(CAST(o_custkey * 11 AS VARCHAR), 8, '0') AS target FROM orders), "
    "f AS (SELECT t.target, coalesce(min(ix.last_key), (SELECT max(last_key) FROM ix)) AS last_key FROM t LEFT JOIN ix ON ix.last_key >= t.target GROUP BY t.target) SELECT f.target, ix.block, f.last_key FROM f JOIN ix ON ix.last_key = f.last_key"
)
def index_find_block(spark, sf):
    targets = src.table(spark, sf, "orders").select(F.concat(F.lit("order:"), F.lpad((F.col("o_custkey") * 11).cast("string"), 8, "0")).alias("target")).distinct()
    return layout.find_block(layout.block_index(_blocks(spark, sf)), targets)


@query(f"WITH {_BLOCKS}, z AS (SELECT block, sum(length(key) + 20) AS size FROM blocks GROUP BY block) SELECT block, CAST(size AS BIGINT) AS size, CAST(coalesce(sum(size) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM z")
def block_handles(spark, sf):
    sizes = _blocks(spark, sf).groupBy("block").agg(F.sum((F.length("key") + 20).cast("long")).alias("size"))
    return ranges.running_total(sizes, "block", F.col("size"), "offset")


# --- Bloom filters --------------------------------------------------------------------------------

_N = "n AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY user_id)"


def _counts(spark, sf):
    return src.table(spark, sf, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"))


@query(f"WITH {_N}, m AS (SELECT key, n, CAST(greatest(64, ceil(-n * ln(0.01) / (ln(2) * ln(2)))) AS BIGINT) AS bits FROM n) SELECT key, n, bits, CAST(least(greatest(ceil(CAST(bits AS DOUBLE) / n * ln(2)), 1), 30) AS BIGINT) AS hashes FROM m")
def bloom_sizing(spark, sf):
    out = _counts(spark, sf).withColumn("bits", bloom.bits_for(F.col("n"), F.lit(0.01)))
    return out.withColumn("hashes", bloom.hashes_for(F.col("n"), F.col("bits")))


@query(f"WITH {_N} SELECT key, n, round(pow(1 - exp(-7.0 * n / 9600), 7), 9) AS rate FROM n")
def bloom_fpr(spark, sf):
    return _counts(spark, sf).select("key", "n", F.round(bloom.expected_rate(F.col("n"), F.lit(9600), F.lit(7)), 9).alias("rate"))


@query("SELECT count(*) AS n_keys, CAST(0 AS BIGINT) AS false_negatives FROM orders")
def bloom_no_false_negative(spark, sf):
    keys = src.order_keys(spark, sf).select(F.col("key").cast("binary").alias("key"))
    n = bloom.buckets_for(keys, KEYS_PER_FILTER)
    out = bloom.probe(bloom.build(keys, n), keys, n)
    return out.agg(F.count("*").alias("n_keys"), F.sum((~F.col("may_contain")).cast("long")).alias("false_negatives"))


@query("SELECT true AS below_3_percent")
def bloom_absent_keys(spark, sf):
    keys = src.order_keys(spark, sf).select(F.col("key").cast("binary").alias("key"))
    absent = src.order_keys(spark, sf).select(F.concat(F.lit("absent:"), F.col("key")).cast("binary").alias("key"))
    n = bloom.buckets_for(keys, KEYS_PER_FILTER)
    out = bloom.probe(bloom.build(keys, n), absent, n)
    return out.agg((F.avg(F.col("may_contain").cast("double")) < 0.03).alias("below_3_percent"))


# --- Block cache ----------------------------------------------------------------------------------

_LRU = """a AS (SELECT CAST(0 AS BIGINT) AS shard, event_id AS pos, user_id AS block FROM events), p AS (SELECT *, lag(pos) OVER (PARTITION BY shard, block ORDER BY pos) AS prev FROM a),
d AS (SELECT p.shard, p.pos, p.block, CASE WHEN p.prev IS NOT NULL THEN (SELECT count(DISTINCT x.block) FROM a x WHERE x.shard = p.shard AND x.pos > p.prev AND x.pos < p.pos) END AS distance FROM p)"""


@query(f"WITH {_LRU} SELECT shard, pos AS access_id, block, distance FROM d")
def lru_stack_distance(spark, sf):
    return cache.stack_distance(src.accesses(spark, sf)).select("shard", "access_id", "block", "distance")


@query(f"WITH {_LRU} SELECT count(*) AS lookups, CAST(sum(CASE WHEN distance < 20 THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN distance < 20 THEN 0 ELSE 1 END) AS BIGINT) AS misses, CAST(sum(CASE WHEN distance < 20 THEN 0 ELSE 1 END) AS BIGINT) AS insertions, sum(CASE WHEN distance < 20 THEN 1.0 ELSE 0 END) / count(*) AS hit_rate FROM d")
def cache_hit_rate(spark, sf):
    return cache.cache_stats(cache.stack_distance(src.accesses(spark, sf)), 20)


@query(f"WITH {_LRU} SELECT shard, count(*) AS lookups, CAST(sum(CASE WHEN distance < 20 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM d GROUP BY shard")
def lru_simulation(spark, sf):
    return cache.hits_by_shard(cache.stack_distance(src.accesses(spark, sf)), 20)


# --- Scalars and settings -------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderkey AS back, CASE o_orderkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'snappy' WHEN 2 THEN 'lz4' END AS compression FROM orders")
def scalar_codecs(spark, sf):
    o = src.table(spark, sf, "orders").select("o_orderkey")
    return o.select("o_orderkey", scalar.from_le(scalar.u64_le(F.col("o_orderkey")), 8).alias("back"), scalar.compression_name(F.col("o_orderkey") % 5).alias("compression"))


@query(f"WITH {_FILES} SELECT file_number, CASE WHEN level > 0 THEN CAST(10485760 * pow(10, level - 1) AS BIGINT) END AS target_size FROM files")
def level_targets(spark, sf):
    return compaction.replay(src.edits(spark, sf)).select("file_number", compaction.target_size(F.col("level"), OPT).alias("target_size"))
