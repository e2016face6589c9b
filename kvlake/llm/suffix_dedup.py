"""Removal of repeated byte strings by hash-compared suffix sorting.

Every byte covered by a ``width``-byte string that also starts anywhere else, in
any document, is removed; overlapping starts count; matches never cross texts.

*Anchors.*  Each window of ``width`` bytes takes as its anchor the place in it
whose ``gram``-byte hash is least.  Equal windows have equal anchors at equal
places, so only windows of equal anchors need be compared.  Runs of windows with
one anchor form a *context* (the bytes they cover).  Contexts are counted in
slices, by a 128-bit digest of their bytes; one that occurs twice repeats as a
whole.  What is left are the different contexts of an anchor: the edges of
repeated passages.

*Suffix sort.*  Those contexts are dealt by anchor and sorted twice: by the bytes
that follow the anchor, and by those before it, read backwards.  Two suffixes are
compared by their longest common extension, found by binary search over prefix
polynomial hashes, and by the byte after it; runs are merged bottom-up, all
comparisons of a level at once.  The extensions that neighbours share are then
counted on the bytes themselves; if a collision has put two suffixes in the wrong
order, the block is sorted by its bytes.  Two windows at one place of the anchor
are equal if their left ends share one class of the one order and their right
ends one class of the other.

*Hot anchors.*  Where an anchor has more than ``hot`` different contexts, they go
to no one task: their windows are counted one by one, by 128-bit digests and with
map-side combine.

Defined results: a null text is empty; a text shorter than ``width`` stays.
Repeated rows are texts of their own, so each makes the other repeat.  Rows with
a null id take part.  A very long text is read in segments that overlap by
``width`` - 1 bytes.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm import bytesops as B
from kvlake.llm.common import bound_batches, parts_for, store

WIDTH = 200
GRAM = 64
BLOCK = 1 << 21  # bytes of contexts sorted at once
HOT = 20_000  # contexts
_U = np.uint64
_PLACE_BITS = 26  # places within a segment, which is shorter
REPEATS, COMPARE, WINDOWS = 1, 2, 4


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    out, have = a, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (w - have)], out[w - have :]) if w > have else out


def contexts(data: np.ndarray, offs: np.ndarray, width: int, gram: int):
    """(row, first window, last window, anchor place, anchor hash, two halves of
    the digest) of each run of windows with one anchor."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none, none.astype(_U), none.astype(_U), none.astype(_U)
    prefix = B.prefix_hash(data)
    at = np.arange(n - gram + 1)
    h = B.span_hash(prefix, at, at + gram)
    low = _U((1 << _PLACE_BITS) - 1)
    least = _sliding_min((h & ~low) | (at.astype(_U) & low), width - gram + 1)
    starts = np.arange(n - width + 1)
    end = np.repeat(offs[1:], np.diff(offs))
    good = starts + width <= end[starts]
    place = starts + ((least - starts.astype(_U)) & low).astype(np.int64)
    change = np.r_[True, (place[1:] != place[:-1]) | (end[starts[1:]] != end[starts[:-1]])]
    first = np.flatnonzero(good & (change | np.r_[True, ~good[:-1]]))
    last = np.flatnonzero(good & np.r_[change[1:] | ~good[1:], True])
    c = np.frombuffer(_digests(data, first, last + width), _U).reshape(-1, 2)
    row = np.searchsorted(offs, first, side="right") - 1
    return row, first, last, place[first], h[place[first]], c[:, 0], c[:, 1]


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """128 bits of each span."""
    view = memoryview(np.ascontiguousarray(data))
    return b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())])


POSTING = (_U, _U, _U, np.int64, np.int64)  # anchor, digest, id, key of the text


@B.tidied
def _postings(batches, width, gram, slices):
    """Anchors and contexts in slices, one posting for each different context of a
    batch; contexts that repeat within the batch are also told so at once."""
    shift = _U(64 - slices.bit_length() + 1)
    for batch in (part for whole in batches for part in B.pieces(whole, 2)):
        ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        parts = [[], [], [], [], []]
        for rows, _, data, offs in B.segments(batch.column(2), width - 1):
            row, _, _, _, h, c, e = contexts(data, offs, width, gram)
            for p, v in zip(parts, (h, c, e, ids[rows[row]], keys[rows[row]])):
                p.append(v)
        if not parts[0]:
            continue
        h, c, e, d, t = (np.concatenate(p) for p in parts)
        if not len(h):
            continue
        order = np.lexsort((e, c, h))
        h, c, e, d, t = (x[order] for x in (h, c, e, d, t))
        head = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (e[1:] != e[:-1])])
        size = np.diff(np.r_[head, len(h)])
        again = np.repeat(size > 1, size)
        ready = [x[again].tobytes() for x in (h, c, e, d, t)]
        many = (size > 1).astype(np.uint8)
        h, c, e, d, t = (x[head] for x in (h, c, e, d, t))
        kinds, first = np.unique((h >> shift).astype(np.int64), return_index=True)
        bounds = np.r_[first, len(h)]
        blobs = [b"".join(x[a:b].tobytes() for x in (h, c, e, d, t, many)) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([*kinds.tolist(), -1 - int(h[0] % _U(1 << 30))], pa.int64()), pa.array([*blobs, b"".join(ready)], pa.binary())], names=["slice", "blob"])


def _columns(blob: bytes, flags: bool):
    n = len(blob) // (8 * len(POSTING) + flags)
    return [np.frombuffer(blob, t, n, 8 * n * i) for i, t in enumerate(POSTING)] + ([np.frombuffer(blob, np.uint8, n, 8 * n * len(POSTING))] if flags else [])


def _judge(key, table, hot):
    """(id, tkey, h, c, e, kind) of contexts that repeat or must be compared."""
    blobs = [b.as_py() for b in table.column("blob")]
    if key[0].as_py() < 0:
        h, c, e, d, t = (np.concatenate(x) for x in zip(*(_columns(b, False) for b in blobs)))
        kind = np.full(len(h), REPEATS, np.int8)
    else:
        h, c, e, d, t, many = (np.concatenate(x) for x in zip(*(_columns(b, True) for b in blobs)))
        order = np.lexsort((e, c, h))
        h, c, e, d, t, many = (x[order] for x in (h, c, e, d, t, many))
        new_h = np.r_[True, h[1:] != h[:-1]]
        new_c = new_h | np.r_[True, (c[1:] != c[:-1]) | (e[1:] != e[:-1])]
        group = np.cumsum(new_c) - 1
        seen = np.bincount(group) + np.bincount(group, weights=many).astype(np.int64)
        anchor = np.cumsum(new_h) - 1
        different = np.bincount(anchor[new_c])[anchor]
        edge = np.where(different > hot, WINDOWS, COMPARE)
        kind = np.where(seen[group] > 1, REPEATS, 0) + np.where(new_c & (different > 1), edge, 0)
        keep = kind > 0
        h, c, e, d, t, kind = (x[keep] for x in (h, c, e, d, t, kind))
    cols = {"id": d, "tkey": t, "h": h.view(np.int64), "c": c.view(np.int64), "e": e.view(np.int64), "kind": kind.astype(np.int8)}
    return pa.table({k: pa.array(v) for k, v in cols.items()})


@B.tidied
def _look_up(batches, width, gram):
    """Spans that repeat whole (h null), and contexts to compare."""
    for batch in batches:
        ids, keys = batch.column("id").to_pylist(), batch.column("tkey").to_pylist()
        lists = batch.column("found")
        out = [[] for _ in range(8)]
        for rows, bases, data, offs in B.segments(batch.column("text"), width - 1):
            row, first, last, p, h, c, e = contexts(data, offs, width, gram)
            bounds = np.searchsorted(row, np.arange(len(rows) + 1))
            for k, r in enumerate(rows.tolist()):
                a, b = bounds[k], bounds[k + 1]
                if a == b or not lists[r].is_valid:
                    continue
                kinds: dict[tuple, int] = {}
                for f in lists[r].as_py():
                    of = (f["h"], f["c"], f["e"])
                    kinds[of] = kinds.get(of, 0) | f["kind"]
                spans, base = [], int(offs[k] - bases[k])
                for i, of in zip(range(a, b), zip(*(x[a:b].view(np.int64).tolist() for x in (h, c, e)))):
                    kind = kinds.get(of, 0)
                    if kind & REPEATS:
                        spans += [int(first[i]) - base, int(last[i]) + width - base]
                    if kind & (COMPARE | WINDOWS):
                        for o, v in zip(out, (ids[r], keys[r], None, of[0], int(first[i]) - base, int(p[i] - first[i]), data[first[i] : last[i] + width].tobytes(), kind & WINDOWS > 0)):
                            o.append(v)
                if spans:
                    for o, v in zip(out, (ids[r], keys[r], spans, None, None, None, None, None)):
                        o.append(v)
        types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=["id", "tkey", "spans", "h", "start", "delta", "bytes", "hot"])


class SuffixSorter:
    """Sorts suffixes ``data[start : start + size]``, within groups, comparing by hashes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray):
        self.data, self.starts, self.sizes, self.group = data, starts, sizes, group
        self.prefix = B.prefix_hash(data)
        padded, self.head = np.r_[data, np.zeros(8, np.uint8)], np.zeros(len(starts), _U)
        for i in range(8):  # the first bytes, which settle most comparisons
            self.head |= np.where(sizes > i, padded[np.minimum(starts + i, len(data))], 0).astype(_U) << _U(56 - 8 * i)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair, by binary search over hashes."""
        a, b = self.starts[x], self.starts[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.sizes[x], self.sizes[y])
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = B.span_hash(self.prefix, a, a + mid) == B.span_hash(self.prefix, b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def before(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y; equal ones as ``ties`` says."""
        out = self.head[x] < self.head[y]
        k = np.flatnonzero(self.head[x] == self.head[y])
        x, y = x[k], y[k]
        n = self.common(x, y)
        inside = n < np.minimum(self.sizes[x], self.sizes[y])
        at = np.where(inside, n, 0)
        last = len(self.data) - 1
        by_byte = self.data[np.minimum(self.starts[x] + at, last)] < self.data[np.minimum(self.starts[y] + at, last)]
        by_size = (self.sizes[x] < self.sizes[y]) | ((self.sizes[x] == self.sizes[y]) & ties[k])
        out[k] = np.where(inside, by_byte, by_size)
        return out

    def sort(self) -> np.ndarray:
        """Order of the suffixes within each group (groups are contiguous):
        bottom-up mergesort, each element's rank in the sibling run found by
        binary search, all elements of a level at once."""
        n = len(self.starts)
        order = np.arange(n)
        first = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]])
        size = np.diff(np.r_[first, n])
        base, total = np.repeat(first, size), np.repeat(size, size)
        inner = np.arange(n) - base
        run = 1
        while run < (size.max() if n else 0):
            left = (inner // run) % 2 == 0
            own = inner // run * run
            other = np.where(left, own + run, own - run)
            count = np.clip(total - other, 0, run)
            low, high = np.zeros(n, np.int64), count.copy()
            while True:
                todo = np.flatnonzero(low < high)
                if not len(todo):
                    break
                mid = (low[todo] + high[todo]) >> 1
                theirs = order[base[todo] + other[todo] + mid]
                earlier = self.before(theirs, order[todo], ~left[todo])
                low[todo] = np.where(earlier, mid + 1, low[todo])
                high[todo] = np.where(earlier, high[todo], mid)
            to = base + np.minimum(own, other) + (inner - own) + low
            merged = np.empty(n, np.int64)
            merged[to] = order
            order = merged
            run *= 2
        return order


def shared(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, bool]:
    """Bytes that each suffix shares with the one before it in ``order`` (-1 where
    a group begins), counted on the bytes; and whether the order is right."""
    s, n, g = starts[order], sizes[order], group[order]
    out = np.full(len(order), -1, np.int64)
    span, last, right = np.arange(sizes.max(initial=1)), len(data) - 1, True
    pairs = np.flatnonzero(g[1:] == g[:-1])
    for i in range(0, len(pairs), 4096):
        k = pairs[i : i + 4096]
        x, y = (data[np.minimum(s[j][:, None] + span, last)] for j in (k, k + 1))
        most = np.minimum(n[k], n[k + 1])
        differ = (x != y) | (span >= most[:, None])
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
        out[k + 1] = at
        rows, inside = np.arange(len(k)), at < most
        at = np.where(inside, at, 0)
        right &= bool(np.where(inside, x[rows, at] < y[rows, at], n[k] <= n[k + 1]).all())
    return out, right


def sorted_classes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(order, bytes shared with the one before) of suffixes; the first ``skip``
    bytes are taken to be equal within a group until the bytes are looked at."""
    order = SuffixSorter(data, starts + skip, sizes - skip, group).sort()
    same, right = shared(data, starts, sizes, group, order)
    if not right:  # a collision of hashes
        keys = [(g, data[a : a + n].tobytes()) for g, a, n in zip(group.tolist(), starts.tolist(), sizes.tolist())]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        same, _ = shared(data, starts, sizes, group, order)
    return order, same


def _compare_block(rows: list[tuple], width: int, gram: int):
    """Repeated windows of contexts of whole anchors: rows (id, tkey, h, start, delta, bytes)."""
    sizes = np.array([len(r[5]) for r in rows])
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    delta = np.array([r[4] for r in rows])
    anchor = np.cumsum(sizes) - sizes + delta
    hs = np.array([r[2] for r in rows])
    group = np.cumsum(np.r_[False, hs[1:] != hs[:-1]])
    order_r, same_r = sorted_classes(data, anchor, sizes - delta, group, gram)
    order_l, same_l = sorted_classes(np.ascontiguousarray(data[::-1]), len(data) - anchor, delta, group)
    n = len(rows)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    found = []
    for back in range(width - gram + 1):  # windows that start so many bytes before the anchor
        here = np.flatnonzero((delta >= back) & (delta - back <= sizes - width))
        if len(here) < 2:
            continue
        left[order_l] = np.cumsum(same_l < back)
        right[order_r] = np.cumsum(same_r < width - back)
        key = left[here] * (n + 1) + right[here]
        by = np.argsort(key, kind="stable")
        key, here = key[by], here[by]
        equal = key[1:] == key[:-1]
        hit = here[np.r_[False, equal] | np.r_[equal, False]]
        found.append(np.stack([hit, delta[hit] - back]))
    if not found:
        return []
    who, inner = np.concatenate(found, axis=1)
    order = np.lexsort((inner, who))
    who, inner = who[order], inner[order]
    cut = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (inner[1:] != inner[:-1] + 1)]) if len(who) else []
    out = []
    for a, b in zip(cut, [*cut[1:], len(who)]):
        r = rows[who[a]]
        out.append((r[0], r[1], [r[3] + int(inner[a]), r[3] + int(inner[b - 1]) + width]))
    return out


@B.tidied
def _compare(batches, width, gram, block):
    """Streams contexts sorted by anchor, sorting about ``block`` bytes of them at once."""

    def emit(found):
        ids, keys, spans = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(spans, pa.list_(pa.int64()))], names=["id", "tkey", "spans"])

    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("id", "tkey", "h", "start", "delta", "bytes"))):
            if size >= block and row[2] != held[-1][2]:
                if found := _compare_block(held, width, gram):
                    yield emit(found)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held and (found := _compare_block(held, width, gram)):
        yield emit(found)


@B.tidied
def _windows(batches, width):
    """A row for each window of hot contexts: two halves of its digest and its place."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):
            batch = whole.slice(lo, 512)
            data, offs = B.text_buffers(batch.column("bytes"))
            count = np.diff(offs) - width + 1
            row = np.repeat(np.arange(batch.num_rows), count)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = offs[row] + inner
            w = np.frombuffer(_digests(data, at, at + width), np.int64).reshape(-1, 2)
            cols = [w[:, 0], w[:, 1], *(batch.column(n).to_numpy()[row] for n in ("id", "tkey")), batch.column("start").to_numpy()[row] + inner]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["w1", "w2", "id", "tkey", "start"])


@B.tidied
def _finish(batches):
    for batch in batches:
        texts, lists = batch.column("text").to_pylist(), batch.column("lists")
        n_bytes, removed, runs, digest, kept_text = [], [], [], [], []
        for i, text in enumerate(texts):
            raw = (text or "").encode()
            spans = sorted((v[j], v[j + 1]) for v in (lists[i].as_py() or []) for j in range(0, len(v), 2))
            kept, at, n, gone, end = [], 0, 0, 0, -1
            for s, e in spans:
                if s > end:
                    n += 1
                s = max(s, at)
                if e > s:
                    kept.append(raw[at:s])
                    gone += e - s
                    at = e
                end = max(end, e)
            kept.append(raw[at:])
            left = b"".join(kept)
            n_bytes.append(len(raw))
            removed.append(gone)
            runs.append(n)
            digest.append(hashlib.sha256(left).hexdigest())
            kept_text.append(left)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id0"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.binary())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """A row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 and
    kept (the bytes left; cut characters are possible, so it is binary)."""
    gram = min(gram, width)
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    id0 = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(id0.alias("id0"), F.coalesce(id0, F.lit(-(1 << 62))).alias("id"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    slices = parts_for(docs)
    blocks = rows.select("id", "tkey", "text").mapInArrow(partial(_postings, width=width, gram=gram, slices=slices), "slice long, blob binary")
    judged = blocks.groupBy("slice").applyInArrow(lambda key, table: _judge(key, table, hot), "id long, tkey long, h long, c long, e long, kind byte")
    lists = judged.groupBy("id", "tkey").agg(F.collect_list(F.struct("h", "c", "e", "kind")).alias("found"))
    asked = rows.select("id", "tkey", "text").join(store(lists), ["id", "tkey"])
    looked = store(asked.mapInArrow(partial(_look_up, width=width, gram=gram), "id long, tkey long, spans array<long>, h long, start long, delta long, bytes binary, hot boolean"))
    edges = looked.where("h is not null and not hot").select("id", "tkey", "h", "start", "delta", "bytes").repartition("h").sortWithinPartitions("h")
    found = edges.mapInArrow(partial(_compare, width=width, gram=gram, block=block), "id long, tkey long, spans array<long>")
    windows = looked.where("h is not null and hot").select("id", "tkey", "start", "bytes").mapInArrow(partial(_windows, width=width), "w1 long, w2 long, id long, tkey long, start long")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    hit = windows.join(twice, ["w1", "w2"], "left_semi").select("id", "tkey", F.array("start", F.col("start") + width).alias("spans"))
    spans = looked.where("spans is not null").select("id", "tkey", "spans").unionByName(found).unionByName(hit)
    spans = spans.groupBy("id", "tkey").agg(F.collect_list("spans").alias("lists"))
    out = rows.join(spans, ["id", "tkey"], "left").select("id0", "text", "lists")
    done = out.mapInArrow(_finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.withColumnRenamed("id", id_col)
