"""Line dedup with two Bloom filters (once-seen, twice-seen).

1. Every task sends the 64-bit hashes of its line keys, cut into hash slices.
   A reducer per slice fills a *once-seen* filter and, for hashes it meets a
   second time, a *twice-seen* filter.  The once filters stay in the reducers;
   the twice filters, of at most ``max_filter_bits`` bits together, are broadcast.
2. Only lines that the twice filter suspects shuffle: a 16-byte digest and the
   document.  An aggregate with map-side combine confirms exactly which keys
   are in two documents and which document is first.
3. The digests to drop go back to their documents, which are rewritten.  Documents
   without a suspected line pass by; their texts do not shuffle.

A full filter only means more suspects, never another result.  A line that very
many documents hold is reduced to its first document before the shuffle, and
Spark may split the join that takes this back to them.

Defined results: a null or empty text is one empty line.  Rows of one doc_id
count as one document and each keeps or loses its lines alike.  A row with a
null doc_id takes no part and stays as it is.  A very long text is one row and
is rewritten whole.  Other columns pass through; one named like an added column
is replaced.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlake.llm import bytesops as B
from kvlake.llm.common import bound_batches, parts_for, store, without

MIN_CHARS = 10
MAX_FILTER_BITS = 1 << 28
PROBES = 3
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
ADDED = ("n_lines", "n_dropped")


def _keys(data, offs, min_chars):
    """Row, start, end and hash of every line whose key is long enough."""
    start, end, per_row = B.lines(data, offs)
    row = np.repeat(np.arange(len(per_row)), per_row)
    wide = end - start >= min_chars
    start, end, row = start[wide], end[wide], row[wide]
    solid = np.flatnonzero(~B.white(data))
    if not len(solid) or not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~B.white(data), out=seen[1:])
    some = seen[end] > seen[start]
    start, end, row = start[some], end[some], row[some]
    start, end = solid[seen[start]], solid[seen[end] - 1] + 1
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    long = points[end] - points[start] >= min_chars
    start, end, row = start[long], end[long], row[long]
    return row, start, end, B.span_hash(B.prefix_hash(data, B.VALUES_LOWER), start, end)


@B.tidied
def _sliced_hashes(batches, slices, min_chars):
    shift = np.uint64(64 - slices.bit_length() + 1)
    for batch in batches:
        found = []
        for lo, hi, data, offs in B.chunks(batch.column(1)):
            row, _, _, h = _keys(data, offs, min_chars)
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            if len(h):
                new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
                found.append(h[new])
        if not found:
            continue
        h, n = np.unique(np.concatenate(found), return_counts=True)
        h = np.sort(np.concatenate([h, h[n > 1]]))  # twice is enough to know
        cut = (h >> shift).astype(np.int64)
        ids, at = np.unique(cut, return_index=True)
        ends = np.r_[at[1:], len(h)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int32()), pa.array([h[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())],
            names=["slice", "hashes"],
        )


def _bits(h: np.ndarray, size: int) -> np.ndarray:
    """Positions of the probes of each hash in a filter of ``size`` bits (a power of two)."""
    a, b = B.mix(h), B.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return np.stack([((a + np.uint64(i) * b) & np.uint64(size - 1)).astype(np.int64) for i in range(PROBES)])


class Filter:
    """A Bloom filter over 64-bit hashes, as it is built: a byte a bit."""

    def __init__(self, expected: int, most: int):
        size = 1 << max(6, (12 * max(expected, 1) - 1).bit_length())
        self.bits = np.zeros(min(size, most), bool)

    def add(self, h):
        self.bits[_bits(h, len(self.bits)).ravel()] = True

    def has(self, h):
        return self.bits[_bits(h, len(self.bits))].all(axis=0)

    def packed(self) -> bytes:
        return np.packbits(self.bits, bitorder="little").tobytes()


class Packed:
    """A filter as it is sent: eight bits a byte."""

    def __init__(self, raw: bytes):
        self.bits = np.frombuffer(raw, np.uint8)

    def has(self, h):
        at = _bits(h, 8 * len(self.bits))
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _twice_filter(key, table: pa.Table, most):
    """Both filters of one slice; returns the twice-seen one."""
    blobs = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("hashes")]
    once = Filter(sum(map(len, blobs)), 1 << 40)
    again = []
    for h in blobs:
        h, n = np.unique(h, return_counts=True)
        seen = once.has(h)
        again.append(h[seen | (n > 1)])
        once.add(h[~seen])
    again = np.unique(np.concatenate(again))
    if not len(again):
        return pa.table({"slice": pa.array([], pa.int32()), "bits": pa.array([], pa.binary())})
    twice = Filter(len(again), most)
    twice.add(again)
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([twice.packed()], pa.binary())})


def _suspected(column, filters, slices, min_chars):
    """First row, data, and (row, start, end) of the suspected lines of each chunk."""
    shift = np.uint64(64 - slices.bit_length() + 1)
    for lo, hi, data, offs in B.chunks(column):
        row, start, end, h = _keys(data, offs, min_chars)
        order = np.argsort(h, kind="stable")
        row, start, end, h = row[order], start[order], end[order], h[order]
        cut = (h >> shift).astype(np.int64)
        kinds, at = np.unique(cut, return_index=True)
        hit = np.zeros(len(h), bool)
        for k, a, b in zip(kinds.tolist(), at, np.r_[at[1:], len(h)]):
            if k in filters:
                hit[a:b] = filters[k].has(h[a:b])
        yield lo, data, row[hit], start[hit], end[hit]


def _filters(sent):
    return {k: Packed(v) for k, v in sent.value.items()}


@B.tidied
def _flag(batches, sent, id_at, text_at, slices, min_chars, schema):
    """Rows with whether they may lose lines."""
    filters = _filters(sent)
    for batch in batches:
        may = np.zeros(batch.num_rows, bool)
        for lo, _, row, _, _ in _suspected(batch.column(text_at), filters, slices, min_chars):
            may[lo + row] = True
        may &= batch.column(id_at).is_valid().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(may)], names=schema)


@B.tidied
def _suspects(batches, sent, slices, min_chars):
    filters = _filters(sent)
    for batch in batches:
        ids, docs, digests = batch.column(0), [], []
        for lo, data, row, start, end in _suspected(batch.column(1), filters, slices, min_chars):
            whole = data.tobytes().lower()
            seen = set()
            for r, s, e in zip(row.tolist(), start.tolist(), end.tolist()):
                d = (hashlib.blake2b(whole[s:e], digest_size=16).digest(), r)
                if d not in seen:
                    seen.add(d)
                    digests.append(d[0])
                    docs.append(lo + r)
        taken = ids.take(pa.array(docs, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), taken.cast(pa.int64())], names=["digest", "doc"])


@B.tidied
def _rewrite(batches, id_at, text_at, drop_at, schema, min_chars):
    """Rows less the lines to drop; bytes.lower() touches A-Z only."""
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        drops, column = batch.column(drop_at), batch.column(text_at)
        has = np.flatnonzero(drops.is_valid().to_numpy(zero_copy_only=False))
        changed: dict[int, tuple[bytes, int]] = {}
        for i in has.tolist():
            gone = set(drops[i].as_py())
            kept, lost = [], 0
            for line in (column[i].as_py() or "").encode().split(b"\n"):
                key = line.strip(WHITE).lower()
                if len(key) >= min_chars and hashlib.blake2b(key, digest_size=16).digest() in gone:
                    lost += 1
                else:
                    kept.append(line)
            changed[i] = (b"\n".join(kept), lost)
        data, offs = B.text_buffers(column)
        nl = np.flatnonzero(data == 10)
        n_lines = np.diff(np.searchsorted(nl, offs)) + 1
        raw = column.to_pylist() if changed else None
        if changed:
            for i, (text, lost) in changed.items():
                raw[i] = text.decode()
            column = pa.array(raw, pa.string())
        n_dropped = np.zeros(len(n_lines), np.int64)
        for i, (_, lost) in changed.items():
            n_dropped[i] = lost
        cols = [column if i == text_at else c for i, c in enumerate(batch.columns) if i != drop_at]
        cols += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=schema)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``docs`` with repeated lines dropped, plus ``n_lines`` (before) and ``n_dropped``."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = without(docs, *ADDED)
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")).where("doc is not null")
    slices = parts_for(docs)
    twice = (
        narrow.mapInArrow(partial(_sliced_hashes, slices=slices, min_chars=min_chars), "slice int, hashes binary")
        .groupBy("slice")
        .applyInArrow(lambda key, table: _twice_filter(key, table, max_filter_bits // slices), "slice int, bits binary")
    )
    # at most max_filter_bits / 8 bytes in all, whatever the input
    filters = spark.sparkContext.broadcast({r["slice"]: bytes(r["bits"]) for r in twice.toLocalIterator()})
    suspects = store(narrow.mapInArrow(partial(_suspects, sent=filters, slices=slices, min_chars=min_chars), "digest binary, doc long"))
    # stored, so that the join is a stage of its own, which Spark can split at a hot line
    first = store(suspects.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("digest", "first"))
    drops = (
        suspects.join(first, "digest").where("doc > first").groupBy("doc").agg(F.collect_set("digest").alias("_ld_drop")).withColumnRenamed("doc", "_ld_doc")
    )
    at = [c.lower() for c in docs.columns]
    flag = partial(_flag, sent=filters, id_at=at.index(id_col.lower()), text_at=at.index(text_col.lower()), slices=slices, min_chars=min_chars)
    flagged_schema = T.StructType([*docs.schema.fields, T.StructField("_ld_may", T.BooleanType())])
    flagged = docs.mapInArrow(partial(flag, schema=flagged_schema.names), flagged_schema)
    may = flagged.where("_ld_may").drop("_ld_may")
    changed = may.join(drops, may[f"`{id_col}`"].cast("long") == drops["_ld_doc"], "left").drop("_ld_doc")
    joined = changed.unionByName(flagged.where("not _ld_may").drop("_ld_may").withColumn("_ld_drop", F.lit(None).cast("array<binary>")))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(
        partial(_rewrite, id_at=at.index(id_col.lower()), text_at=at.index(text_col.lower()), drop_at=len(at), schema=schema.names, min_chars=min_chars), schema
    )
