"""Toxic spans with a linear-chain conditional random field.

*Labelled tokens.*  Labels are by document.  A word of a toxic document is
labelled toxic if it, or its start of seven or five characters, is much likelier
in toxic documents than in others (by a smoothed log odds ratio over the
documents counted); all other words are not.  So words that were never seen can
be tagged by how they begin.  A word's feature is itself if it is known, else its
longest known start.  Word counts are a Spark aggregate over at most ``max_counted`` labelled documents;
the words kept as features are the ``max_words`` with the largest odds, both ways.

*Model.*  Two states (clean, toxic), a weight for each feature word and state,
for the words before and after it, and for each transition.  It is trained by
gradient ascent on the penalised likelihood of at most ``max_train`` labelled
documents (by crc32 of the id), of each the stretches around feature words.

*Scores.*  Words that are no features all score alike, so a stretch of them is
a power of one 2 x 2 matrix; forward-backward runs over the feature words of a
document, with gaps.  Its marginals give the offsets of toxic spans.  The number
of toxic words expected, and its share of the words, go through a logistic curve
fitted on the training documents to give the document's score.

Defined results: a null or empty text, and one without feature words, has the
score of no toxic words.  Repeated rows score alike.  A very long text is scored
whole.  A column named like an added one is replaced.  Training rows need a label
and a doc_id; if there are none, every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlake.llm import bytesops as B
from kvlake.llm.common import bound_batches, store, without

MAX_COUNTED = 8_000
MAX_TRAIN = 3_000
MAX_WORDS = 2_000
MIN_ODDS = 2.0
STARTS = (7, 5)
HELD_OUT, FOLDS = 2, 4
THRESHOLD = 0.3
ADDED = ("score", "toxic_spans", "expected_toxic")
_PUNCTUATION = b".,;:!?\"'()[]{}*#$%&|<>-_=+/\\"
_U = np.uint64


def fold(id_: Column) -> Column:
    """Fold of a document, from crc32 of its id as text."""
    return F.crc32(id_.cast("string").cast("binary")) % FOLDS


def word_list(text: str | None) -> list[str]:
    """Words without punctuation around them, A-Z lower-cased, as scores see them."""
    return [w.strip(_PUNCTUATION).decode(errors="replace") for w in (text or "").encode().lower().split()]


def forms(word: str) -> list[str]:
    """What a word may be known by: itself, or its starts."""
    return [word, *(word[:n] + "*" for n in STARTS if len(word) > n)]


def feature(word: str, known: dict[str, int]) -> int:
    """Id of a word's feature; ``len(known)`` if it has none."""
    for form in forms(word):
        if form in known:
            return known[form]
    return len(known)


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word or start, toxic) once for each document."""
    for batch in batches:
        words, toxic = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            found = {form for w in set(word_list(text)) if w for form in forms(w)}
            words += found
            toxic += [label] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], names=["word", "toxic"])


@dataclass
class Model:
    words: dict[str, int]
    emit: np.ndarray  # (features + 1, 2): by word; the last is any other word
    near: np.ndarray  # (features + 1, 2): by the word before or after
    move: np.ndarray  # (2, 2)
    curve: tuple[float, float, float]  # weight of expected count, of share, and bias

    def potentials(self, ids: np.ndarray) -> np.ndarray:
        """Log potential of each state for a stretch of feature ids."""
        out = self.emit[ids].copy()
        out[1:] += self.near[ids[:-1]]
        out[:-1] += self.near[ids[1:]]
        return out

    def marginals(self, at: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """Probability of toxic at the feature words ``at`` of a text of n words.

        Feature words, their neighbours and the text's ends are taken one by one;
        the words between all score alike, so a gap is a power of one matrix."""
        if not len(at):
            return np.zeros(0)
        other = len(self.words)
        places = np.unique(np.concatenate([at - 1, at, at + 1, [0, n - 1]]))
        places = places[(places >= 0) & (places < n)]

        def kind(where):
            k = np.minimum(np.searchsorted(at, where), len(at) - 1)
            return np.where(at[k] == where, ids[k], other)

        pot = self.emit[kind(places)].copy()
        pot += np.where((places > 0)[:, None], self.near[kind(places - 1)], 0.0)
        pot += np.where((places < n - 1)[:, None], self.near[kind(places + 1)], 0.0)
        pot = np.exp(pot - pot.max(axis=1, keepdims=True))
        step = np.exp(self.move)
        blank = step * np.exp(self.emit[other] + 2 * self.near[other])[None, :]
        values, vectors = np.linalg.eig(blank)
        back = np.linalg.inv(vectors)
        values = values / np.abs(values).max()
        mats = [step if k == 0 else np.real(vectors @ np.diag(values ** int(k)) @ back) @ step for k in np.diff(places) - 1]
        m = len(places)
        fwd, bwd = np.empty((m, 2)), np.full((m, 2), 0.5)
        fwd[0] = pot[0] / pot[0].sum()
        for i in range(1, m):
            a = (fwd[i - 1] @ mats[i - 1]) * pot[i]
            fwd[i] = a / a.sum()
        for i in range(m - 2, -1, -1):
            b = mats[i] @ (pot[i + 1] * bwd[i + 1])
            bwd[i] = b / b.sum()
        p = fwd * bwd
        return np.clip(p[:, 1] / p.sum(axis=1), 0.0, 1.0)[np.searchsorted(places, at)]

    def score(self, expected: np.ndarray, n: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-(a * np.minimum(expected, 3.0) + b * np.minimum(20 * expected / np.maximum(n, 1), 1.0) + c)))


def _stretches(words: list[str], known: dict[str, int], around: int = 3) -> list[np.ndarray]:
    """Ids of the words around feature words (``len(known)`` for other words)."""
    other = len(known)
    ids = np.array([feature(w, known) for w in words], np.int64)
    hit = np.flatnonzero(ids < other)
    if not len(hit):
        return [ids[: 2 * around]] if len(ids) else []
    out, start, last = [], max(0, hit[0] - around), hit[0]
    for h in hit[1:]:
        if h - last > 2 * around:
            out.append(ids[start : last + around + 1])
            start = h - around
        last = h
    out.append(ids[start : last + around + 1])
    return out


def _chain(model: Model, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected moves of a stretch by forward-backward."""
    pot = model.potentials(ids)
    pot = np.exp(pot - pot.max(axis=1, keepdims=True))
    step = np.exp(model.move)
    n = len(ids)
    fwd, bwd = np.empty((n, 2)), np.ones((n, 2))
    fwd[0] = pot[0] / pot[0].sum()
    for i in range(1, n):
        a = (fwd[i - 1] @ step) * pot[i]
        fwd[i] = a / a.sum()
    for i in range(n - 2, -1, -1):
        b = step @ (pot[i + 1] * bwd[i + 1])
        bwd[i] = b / b.sum()
    p = fwd * bwd
    p /= p.sum(axis=1, keepdims=True)
    moves = np.zeros((2, 2))
    for i in range(1, n):
        m = fwd[i - 1][:, None] * step * (pot[i] * bwd[i])[None, :]
        moves += m / m.sum()
    return p, moves


def fit_chain(docs: list[tuple[str | None, int]], odds: dict[str, float], toxic_words: set[str], rounds: int = 30, penalty: float = 1e-3, rate: float = 0.3) -> Model:
    """Train on (text, label) of labelled documents."""
    known = {w: i for i, w in enumerate(odds)}
    k = len(known)
    model = Model(known, np.zeros((k + 1, 2)), np.zeros((k + 1, 2)), np.zeros((2, 2)), (0.0, 0.0, 0.0))
    names = [*known, ""]
    is_toxic = np.array([w in toxic_words for w in names])
    data: dict[tuple, int] = {}
    for text, label in docs:
        for ids in _stretches(word_list(text), known):
            key = (label, *ids.tolist())
            data[key] = data.get(key, 0) + 1
    total = max(1, sum(data.values()))
    cases = [(np.array(key[1:], np.int64), key[0], c / total) for key, c in data.items()]
    speed = [np.zeros_like(a) for a in (model.emit, model.near, model.move)]
    for _ in range(rounds):
        grads = [np.zeros_like(a) for a in (model.emit, model.near, model.move)]
        for ids, label, weight in cases:
            p, moves = _chain(model, ids)
            y = (is_toxic[ids] & (label == 1)).astype(int)
            truth = np.eye(2)[y]
            d = weight * (truth - p)
            np.add.at(grads[0], ids, d)
            if len(ids) > 1:
                np.add.at(grads[1], ids[:-1], d[1:])
                np.add.at(grads[1], ids[1:], d[:-1])
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1.0)
                grads[2] += weight * (seen - moves)
        for a, g, s in zip((model.emit, model.near, model.move), grads, speed):
            g -= penalty * a
            s += g * g
            a += rate * g / (np.sqrt(s) + 1e-8)
    return model


def fit_curve(model: Model, docs: list[tuple[str | None, int]], weights: tuple[float, float] = (1.0, 1.0), steps: int = 500) -> Model:
    """Logistic curve from expected toxic words to the document's label."""
    x, y = [], []
    for text, label in docs:
        ws = word_list(text)
        expected = tag(model, ws)[1]
        x.append([min(expected, 3.0), min(20 * expected / max(len(ws), 1), 1.0), 1.0])
        y.append(label)
    x, y, w = np.array(x), np.array(y, float), np.zeros(3)
    v = np.where(y > 0, weights[1], weights[0])
    for _ in range(steps):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (v * (y - p)) - 1e-2 * w
        h = (x * (v * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        move = np.linalg.solve(h, g)
        w += move
        if np.abs(move).max() < 1e-9:
            break
    model.curve = (max(w[0], 0.0), max(w[1], 0.0), w[2])
    return model


def tag(model: Model, words: list[str]) -> tuple[list[tuple[int, float]], float]:
    """(place, probability of toxic) of the feature words, and the sum of squares: sure words count most."""
    found = np.array([feature(w, model.words) for w in words], np.int64)
    at = np.flatnonzero(found < len(model.words)).tolist()
    if not at:
        return [], 0.0
    ids = found[at]
    p = model.marginals(np.array(at), ids, len(words))
    return list(zip(at, p.tolist())), float((p * p).sum())


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_counted: int = MAX_COUNTED, max_train: int = MAX_TRAIN, max_words: int = MAX_WORDS
) -> Model:
    """Train on a bounded sample of labelled rows outside the held-out fold.

    Of each label at most ``max_counted / 2`` documents are read, the first by a
    hash of the id; the chain sees the first ``max_train / 2`` of each.  The
    curve weighs the labels by their shares among all labelled rows.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").where(fold(F.col("id")) != HELD_OUT).distinct()
    size = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    n_toxic, n_all = size["t"] or 0, size["n"]
    if not n_toxic or n_toxic == n_all:
        return Model({}, np.zeros((1, 2)), np.zeros((1, 2)), np.zeros((2, 2)), (0.0, 0.0, -50.0))
    place = F.crc32(F.concat(F.lit("train"), F.col("id").cast("string")).cast("binary"))
    first = [rows.where(f"toxic = {y}").withColumn("place", place).orderBy("place", "id").limit(max_counted // 2) for y in (0, 1)]
    ids = F.broadcast(first[0].unionByName(first[1]))  # at most max_counted rows
    train = store(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(ids, "id"))
    seen = train.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    s_toxic, s_clean = seen["t"] or 0, seen["n"] - (seen["t"] or 0)
    counts = train.select("text", "toxic").mapInArrow(_document_words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    share = F.ln((F.col("t") + 0.5) / (s_toxic + 1.0)) - F.ln((F.col("n") - F.col("t") + 0.5) / (s_clean + 1.0))
    weighed = store(counts.where("t >= 3 or n - t >= 3").withColumn("odds", share).withColumn("gain", F.col("odds") * F.sqrt(F.col("t"))))
    best = weighed.where(F.col("odds") >= MIN_ODDS).orderBy(F.col("gain").desc(), "word").limit(max_words // 2).collect()
    worst = weighed.where((F.col("odds") < 0) & (F.col("n") < F.lit(0.2 * (s_toxic + s_clean)))).orderBy("odds", "word").limit(min(200, max_words // 2)).collect()
    odds = {r["word"]: r["odds"] for r in [*best, *worst]}
    cases = [
        (r["text"], r["toxic"])
        for y in (0, 1)
        for r in train.where(f"toxic = {y}").orderBy("place", "id", "text").limit(max_train // 2).select("text", "toxic").toLocalIterator()
    ]
    used = sum(y for _, y in cases)
    weights = ((1 - n_toxic / n_all) * len(cases) / max(1, len(cases) - used), n_toxic / n_all * len(cases) / max(1, used))
    return fit_curve(fit_chain(cases, odds, {r["word"] for r in best}), cases, weights)


@B.tidied
def _score(batches, sent, text_at, schema):
    model: Model = sent.value

    def hashes(names):
        raw = [w.encode() for w in names]
        offs = np.cumsum([0, *map(len, raw)])
        return np.sort(B.span_hash(B.prefix_hash(np.frombuffer(b"".join(raw), np.uint8)), offs[:-1], offs[1:]))

    def among(h, table):
        return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h if len(table) else np.zeros(len(h), bool)

    whole = hashes([w for w in model.words if not w.endswith("*")])
    starts = {n: hashes([w[:-1] for w in model.words if w.endswith("*") and len(w) == n + 1]) for n in STARTS}
    edge = np.zeros(256, bool)
    edge[list(_PUNCTUATION)] = True
    for batch in batches:
        n_rows = batch.num_rows
        expected, n_words = np.zeros(n_rows), np.zeros(n_rows, np.int64)
        spans: list[list[int]] = [[] for _ in range(n_rows)]
        for lo, hi, data, offs in B.chunks(batch.column(text_at)):
            start, end, per_row = B.words(data, offs)
            n_words[lo:hi] = per_row
            if not len(start) or not model.words:
                continue
            # a word's inside: from its first to its last byte that is no punctuation
            inside = ~edge[data]
            seen = np.zeros(len(data) + 1, np.int64)
            np.cumsum(inside, out=seen[1:])
            places = np.flatnonzero(inside)
            some = seen[end] > seen[start]
            s, e = start.copy(), start.copy()
            s[some] = places[seen[start[some]]]
            e[some] = places[seen[end[some]] - 1] + 1
            prefix = B.prefix_hash(data, B.VALUES_LOWER)
            seen = among(B.span_hash(prefix, s, e), whole)
            points = np.r_[np.flatnonzero((data & 0xC0) != 0x80), np.full(max(STARTS) + 1, len(data))]
            first = np.searchsorted(points, s)
            for n, table in starts.items():
                cut = points[np.minimum(first + n, len(points) - 1)]
                longer = np.flatnonzero(cut < e)
                seen[longer] |= among(B.span_hash(prefix, s[longer], cut[longer]), table)
            hit = np.flatnonzero(seen)
            if not len(hit):
                continue
            first = np.cumsum(per_row) - per_row
            rows = np.searchsorted(first + per_row, hit, side="right")
            for r in np.unique(rows).tolist():
                at, ids = [], []
                for w in hit[rows == r].tolist() if len(hit) < 64 else hit[np.searchsorted(rows, r) : np.searchsorted(rows, r, side="right")].tolist():
                    k = feature(data[s[w] : e[w]].tobytes().lower().decode(errors="replace"), model.words)
                    if k < len(model.words):
                        at.append(w)
                        ids.append(k)
                if not at:
                    continue
                p = model.marginals(np.array(at) - first[r], np.array(ids), int(per_row[r]))
                expected[lo + r] = (p * p).sum()
                spans[lo + r] = [int(v - offs[r]) for w, q in zip(at, p) if q >= 0.5 for v in (s[w], e[w])]
        cols = [*batch.columns, pa.array(model.score(expected, n_words)), pa.array(spans, pa.list_(pa.int64())), pa.array(expected)]
        yield pa.RecordBatch.from_arrays(cols, names=schema)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score, toxic_spans (byte offsets, start and end in turn) and
    expected_toxic (expected number of toxic words)."""
    docs = without(docs, *ADDED)
    bound_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", T.ArrayType(T.LongType())), T.StructField("expected_toxic", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most max_words features
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    return docs.mapInArrow(partial(_score, sent=sent, text_at=at, schema=schema.names), schema)
