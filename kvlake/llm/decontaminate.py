"""Benchmark decontamination with a generalised suffix automaton.

The benchmark's items become one suffix automaton over words.  Training texts
are streamed through it word by word; the automaton gives, at each word, the
length of the longest match with any item that ends there.  A word inside a
match of at least ``window`` words (or inside a whole item that is shorter) is
hit.  Documents over the coverage limit are contaminated.

Most words of a text can't be in a match: a vectorised test against the hashes
of the automaton's vocabulary finds the stretches worth streaming.  It has no
false negatives, and the stretches are matched on the words themselves.

The benchmark is a stated query set.  It is read in blocks of at most
``block_words`` words; each block's automaton is broadcast, so what is sent has
a bound (about 700 bytes a word), and the documents are streamed once per block.
Between blocks the result so far is stored, so a worker holds one automaton.

Defined results: a null or empty text has no words and is never contaminated.
An item without words has no window.  Equal items each count.  Rows with equal
or null doc_id are judged one by one.  A very long text is streamed in one piece.
A column named like an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlake.llm import bytesops as B
from kvlake.llm.common import bound_batches, store, without

WINDOW = 13
BLOCK_WORDS = 200_000
_TOKEN = np.zeros(256, bool)
_TOKEN[0x30:0x3A] = _TOKEN[0x41:0x5B] = _TOKEN[0x61:0x7B] = True
_TOKEN[0x80:] = True
ADDED = ("n_words", "n_hit", "hit_items", "hit_spans", "contaminated")


def tokens(text: str | None) -> list[bytes]:
    """Words of one text: runs of 0-9, a-z (after lower-casing A-Z) and non-ASCII."""
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    low = raw.lower()
    start, end = B.runs(_TOKEN[data], np.array([0, len(data)]))
    return [low[s:e] for s, e in zip(start.tolist(), end.tolist())]


class Automaton:
    """Generalised suffix automaton of items, each a list of words."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        self.shortest = window
        kept = []
        for name, ws in items:
            if not ws:
                continue
            self.names.append(name)
            self.shortest = min(self.shortest, len(ws))
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]
            kept.append(ids)
            last = 0
            for c in ids:
                last = self._extend(last, c)
        #: (state whose class holds the window) -> items with it
        self.windows: dict[int, set[int]] = {}
        #: state -> [(length, item)] of items shorter than the window
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for k, ids in enumerate(kept):
            state = 0
            for i, c in enumerate(ids):
                state = self.next[state][c]
                if i + 1 >= window:
                    self.windows.setdefault(self._up(state, window), set()).add(k)
            if len(ids) < window:
                self.whole.setdefault(self._up(state, len(ids)), []).append((len(ids), k))
        self.wholes: dict[int, list[tuple[int, int]]] = {0: []}
        if self.whole:  # what a state's suffix links reach
            for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
                self.wholes[s] = self.wholes[self.link[s]] + self.whole.get(s, [])

    def _up(self, state: int, length: int) -> int:
        """The state of the suffix of ``length`` words."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # the prefix is in an earlier item
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, c)
        new, p = len(self.len), last
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c)
        return new

    def hashes(self) -> np.ndarray:
        """Sorted hashes of the vocabulary, as span_hash gives them."""
        ws = list(self.vocabulary)
        data = np.frombuffer(b"".join(ws), np.uint8)
        offs = np.cumsum([0, *map(len, ws)])
        return np.sort(B.span_hash(B.prefix_hash(data), offs[:-1], offs[1:]))

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of words inside matches, and the items matched."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        state = length = 0
        for i, w in enumerate(words):
            c = self.vocabulary.get(w)
            if c is None:
                state = length = 0
                continue
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if c not in self.next[state]:
                continue
            state = self.next[state][c]
            length += 1
            if length >= self.window:
                items |= self.windows[self._up(state, self.window)]
                spans.append((i + 1 - self.window, i + 1))
            if self.whole:
                for n, k in self.wholes[state]:
                    if n <= length:
                        items.add(k)
                        spans.append((i + 1 - n, i + 1))
        return spans, items


def _join(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


@B.tidied
def _match(batches, sent, text_at, schema):
    """Adds, to each row, its word count, hit words, items and byte spans."""
    automaton: Automaton = sent.value
    vocabulary = automaton.hashes()
    least = automaton.shortest
    for batch in batches:
        n = batch.num_rows
        n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
        items: list[list[str]] = [[] for _ in range(n)]
        places: list[list[int]] = [[] for _ in range(n)]
        for lo, hi, data, offs in B.chunks(batch.column(text_at)):
            start, end = B.runs(_TOKEN[data], offs)
            at = np.searchsorted(start, offs)
            n_words[lo:hi] = np.diff(at)
            if not len(start) or not len(vocabulary):
                continue
            h = B.span_hash(B.prefix_hash(data, B.VALUES_LOWER), start, end)
            near = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            first, last = B.runs(vocabulary[near] == h, at)
            wide = last - first >= least
            found: dict[int, tuple[list, set]] = {}
            for a, b in zip(first[wide].tolist(), last[wide].tolist()):
                row = int(np.searchsorted(at, a, side="right")) - 1
                s, e = start[a:b].tolist(), end[a:b].tolist()
                low = data[s[0] : e[-1]].tobytes().lower()
                spans, got = automaton.stream([low[x - s[0] : y - s[0]] for x, y in zip(s, e)])
                if got:
                    all_spans, all_items = found.setdefault(row, ([], set()))
                    all_spans += [(x + a, y + a) for x, y in spans]
                    all_items |= got
            for row, (spans, got) in found.items():
                spans = _join(spans)
                n_hit[lo + row] = sum(y - x for x, y in spans)
                items[lo + row] = [automaton.names[k] for k in got]
                places[lo + row] = [int(v - offs[row]) for x, y in spans for v in (start[x], end[y - 1])]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int64()))],
            names=schema,
        )


def _merge_blocks(batches, text_at, blocks, schema):
    """One result from those of several blocks, which overlap in words."""
    for batch in batches:
        base = batch.columns[: -4 * blocks]
        parts = [batch.columns[len(base) + 4 * k : len(base) + 4 * k + 4] for k in range(blocks)]
        hit, items, places = [], [], []
        for i in range(batch.num_rows):
            spans = _join([tuple(v[j : j + 2]) for p in parts for v in [p[3][i].as_py()] for j in range(0, len(v), 2)])
            raw = (base[text_at][i].as_py() or "").encode() if spans else b""
            hit.append(sum(int(len(B.runs(_TOKEN[np.frombuffer(raw[s:e], np.uint8)], np.array([0, e - s]))[0])) for s, e in spans))
            items.append([x for p in parts for x in p[2][i].as_py()])
            places.append([v for s in spans for v in s])
        yield pa.RecordBatch.from_arrays([*base, parts[0][0], pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int64()))], names=schema)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    """Items with their words, a bounded number of words at a time."""
    block, n = [], 0
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).toLocalIterator()
    for row in rows:
        ws = tokens(row["t"])
        if block and n + len(ws) > block_words:
            yield block
            block, n = [], 0
        block.append((row["i"] or "", ws))
        n += len(ws)
    yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, percent: int = 5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_items (unsorted), hit_spans (byte offsets,
    start and end in turn) and contaminated (hits, of at least ``percent`` % of words)."""
    sc = docs.sparkSession.sparkContext
    bound_batches(docs.sparkSession)
    docs = without(docs, *ADDED)
    text_at = [c.lower() for c in docs.columns].index(text_col.lower())
    base, out = list(docs.schema.fields), docs
    types = [T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.ArrayType(T.LongType())]
    blocks = 0
    for block in _blocks(benchmark, item_col, item_text, block_words):
        schema = T.StructType([*out.schema.fields, *(T.StructField(f"_dc{blocks}_{k}", t) for k, t in enumerate(types))])
        out = (store(out) if blocks else out).mapInArrow(partial(_match, sent=sc.broadcast(Automaton(block, window)), text_at=text_at, schema=schema.names), schema)
        blocks += 1
    schema = T.StructType([*base, *(T.StructField(n, t) for n, t in zip(ADDED[:4], types))])
    out = out.toDF(*schema.names) if blocks == 1 else out.mapInArrow(partial(_merge_blocks, text_at=text_at, blocks=blocks, schema=schema.names), schema)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))


@B.tidied
def _cut(batches, text_at, span_at):
    for batch in batches:
        texts, spans = batch.column(text_at).to_pylist(), batch.column(span_at)
        for i in np.flatnonzero(np.diff(_list_offsets(spans))).tolist():
            raw, at, kept = texts[i].encode(), 0, []
            v = spans[i].as_py()
            for s, e in zip(v[::2], v[1::2]):
                kept.append(raw[at:s])
                at = e
            texts[i] = b"".join([*kept, raw[at:]]).decode()
        cols = list(batch.columns)
        cols[text_at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)


def _list_offsets(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.offsets)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """Documents over the coverage limit go; in the others, spans over the length
    limit are cut out of the text.  Columns stay as they were."""
    names = docs.columns
    found = find_contamination(docs, benchmark, text_col, **how).where("not contaminated")
    at = [c.lower() for c in found.columns]
    return found.mapInArrow(partial(_cut, text_at=at.index(text_col.lower()), span_at=at.index("hit_spans")), found.schema).select(*[f"`{c}`" for c in names if c.lower() not in {x.lower() for x in ADDED}])


def items_digest(items: F.Column) -> F.Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)
