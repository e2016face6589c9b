"""SentencePiece models on the tokenizers library.

The model file (a protobuf message) is parsed here field by field; from it the
normaliser, the metaspace marker, the pieces with their scores and the byte
fallback are rebuilt as a ``tokenizers`` pipeline.  Unigram models keep their
scores; of BPE models the merges are rebuilt from the piece scores.

Where no piece has the marker after another character, a text can be cut before
each run of markers without changing its pieces.  A batch's distinct cuts are
then encoded once, some in a row, in one multithreaded ``encode_batch``, and looked up.  What a
task remembers of cuts is bounded in bytes.

Only normal pieces are found in texts.  Control, unknown, unused and byte pieces
that a text spells out are spelt with other pieces, as the library does;
user-defined pieces are cut out first and stay whole.

Parity: every task holds the model's normalisation of each whole text against
the sentencepiece library's, its pieces against the library's on the distinct
cuts it meets, and each document's decoded text against the text as the model
normalises it.  ``encode`` reports them.

Defined results: a null or empty text has no pieces and decodes to an empty
text.  Repeated rows are encoded alike.  A long text is encoded whole.  A column
named like an added one is replaced.  The model's path is a parameter; it is read
on the driver and sent as bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
import struct
from dataclasses import dataclass, field
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kvlake.llm import bytesops as B
from kvlake.llm.common import bound_batches, without

MARK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
_PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
ADDED = ("ids", "n_tokens", "n_byte_tokens", "decoded", "roundtrip", "parity")

# Fixed values of the model format: piece types, model types, the text of an unknown piece.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_TEXT = " \u2047 "

#: A byte that is no part of a character is one replacement character.
codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _fields(raw: bytes):
    """(number, value) of each field of a protobuf message."""
    at, n = 0, len(raw)

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = raw[at : at + 8], at + 8
        elif kind == 2:
            size = varint()
            value, at = raw[at : at + size], at + size
        elif kind == 5:
            value, at = raw[at : at + 4], at + 4
        else:
            raise ValueError(f"protobuf wire type {kind} is not expected in a model")
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unknown: int = 0
    byte_fallback: bool = False
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    charsmap: bytes = b""
    unknown_text: str = UNKNOWN_TEXT
    marker_after: bool = False


def parse_model(raw: bytes) -> Model:
    """The parts of a model message that encoding and decoding need."""
    m = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    m.kind = v
                elif k == 24:
                    m.marker_after = bool(v)
                elif k == 44:
                    m.unknown_text = v.decode()
                elif k == 35:
                    m.byte_fallback = bool(v)
                elif k == 40:
                    m.unknown = v
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    m.charsmap = v
                elif k == 3:
                    m.add_dummy_prefix = bool(v)
                elif k == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif k == 5:
                    m.escape_whitespaces = bool(v)
    return m


def _merges(m: Model) -> list[tuple[str, str]]:
    """Merges of a BPE model: each piece from the pairs that make it, best pieces first."""
    score = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER_DEFINED)}
    ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    found = []
    for piece, s in score.items():
        pairs = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in score and piece[i:] in score]
        found += [(-s, ids[piece], ids[a], ids[b], a, b) for a, b in pairs]
    return [(a, b) for *_, a, b in sorted(found)]


class Tokenizer:
    """A SentencePiece model rebuilt on the tokenizers library."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer as Backend
        from tokenizers import models, normalizers

        self.model = m = parse_model(raw)
        kinds = {kind for _, _, kind in m.pieces}
        if m.marker_after or (m.kind == BPE and UNUSED in kinds):
            raise ValueError("models with markers after words, or BPE with unused pieces, have no counterpart")
        # a text must not reach pieces by spelling their names: these get names that no text has
        hidden = (CONTROL, UNUSED) if m.kind == BPE else (CONTROL, UNUSED, BYTE)
        names = [f"\0{i}" if kind in hidden else p for i, (p, _, kind) in enumerate(m.pieces)]
        if m.kind == BPE:
            backend = models.BPE({p: i for i, p in enumerate(names)}, _merges(m), unk_token=names[m.unknown], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0)  # each cut comes once
        elif m.kind == UNIGRAM:
            names[m.unknown] = "\0"
            least = min((s for _, s, kind in m.pieces if kind == NORMAL), default=0.0)
            backend = models.Unigram([(n, s if kind == NORMAL else least) for n, (_, s, kind) in zip(names, m.pieces)], unk_id=m.unknown)
        else:
            raise ValueError(f"model type {m.kind} has no counterpart")
        self.normalizer = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        self.backend = Backend(backend)
        self.bytes = {i: int(p[3:5], 16) for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE}
        self.of_byte = {b: i for i, b in self.bytes.items()}
        self.expand = m.kind == UNIGRAM and m.byte_fallback
        self.hidden = {i for i, (_, _, kind) in enumerate(m.pieces) if kind == CONTROL}
        self.is_byte = np.isin(np.arange(len(m.pieces)), list(self.bytes))
        self.user = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind == USER_DEFINED}
        self.user_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.user, key=len, reverse=True))) + ")") if self.user else None
        #: whether each cut's pieces spell it, and nothing but the cut
        self.joins = self.model.byte_fallback and self.model.escape_whitespaces and not self.user
        #: what each piece stands for
        self.spelt = [bytes([self.bytes[i]]) if i in self.bytes else b"" if i in self.hidden else p.encode() for i, (p, _, _) in enumerate(m.pieces)]
        self.spelt[m.unknown] = m.unknown_text.encode()
        self.spelt_data = np.frombuffer(b"".join(self.spelt), np.uint8)
        self.spelt_at = np.r_[0, np.cumsum([*map(len, self.spelt)])]
        self.cuts = not any(p[i] == MARK and p[i - 1] != MARK for p, _, kind in m.pieces if kind == NORMAL for i in range(1, len(p)))
        self.joins = self.joins and self.cuts and len(self.bytes) == 256

    def normalize(self, text: str) -> str:
        if self.normalizer:
            if self.user_cut:  # user-defined pieces are left as they are
                parts = self.user_cut.split(text)
                parts[::2] = map(self.normalizer.normalize_str, parts[::2])
                text = "".join(parts)
            else:
                text = self.normalizer.normalize_str(text)
        if self.model.remove_extra_whitespaces:
            text = " ".join(x for x in text.split(" ") if x)
        return text

    def marked(self, text: str) -> str:
        """Normalised text with the marker for spaces and before the text."""
        text = self.normalize(text)
        if not text:
            return ""
        if self.model.add_dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape_whitespaces else text

    def cut(self, marked: str) -> list[str]:
        """Parts that no piece spans: each starts with a run of markers, or is a
        user-defined piece, or follows one."""
        if self.user_cut:
            return [c for k, part in enumerate(self.user_cut.split(marked)) for c in ([part] if k % 2 else self._cut(part))]
        return self._cut(marked)

    def _cut(self, part: str) -> list[str]:
        return _PART.findall(part) if self.cuts else [part] if part else []

    def encode_many(self, parts: list[str]) -> list[list[int]]:
        encode = self.backend.encode_batch if self.expand else self.backend.encode_batch_fast  # the fast one keeps no texts
        found = encode(parts, add_special_tokens=False)
        out = [e.ids for e in found]
        if self.expand:  # an unknown piece keeps its text; its bytes are its pieces
            for k, ids in enumerate(out):
                if self.model.unknown in ids:
                    spelt = found[k].tokens
                    out[k] = [j for i, t in zip(ids, spelt) for j in ([self.of_byte[b] for b in t.encode()] if i == self.model.unknown else [i])]
        if self.user:
            for k, part in enumerate(parts):
                if part in self.user:
                    out[k] = [self.user[part]]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_many(self.cut(self.marked(text))) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """Text of pieces; runs of byte pieces are UTF-8, wrong bytes are replaced."""
        return self.unmarked(self.bytes_of(ids).decode(errors="each-byte"))

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelt.__getitem__, ids))

    def sized(self, cuts: list[str], ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray] | None:
        """(pieces of each cut, all ids) of cuts encoded in a row; None if a piece
        does not end where its cut does."""
        flat = _flat(ids)[1]
        upto = np.cumsum(self.spelt_at[flat + 1] - self.spelt_at[flat])
        want = np.cumsum(np.fromiter(map(len, map(str.encode, cuts)), np.int64, len(cuts)))
        last = np.searchsorted(upto, want)
        if len(cuts) and (last[-1] != len(upto) - 1 or (upto[last] != want).any()):
            return None
        return np.diff(np.r_[-1, last]), flat

    def flat_bytes(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """What all ids stand for, one after the other, and where each range of them lies."""
        sizes = self.spelt_at[ids + 1] - self.spelt_at[ids]
        upto = np.r_[0, np.cumsum(sizes)]
        at = np.repeat((self.spelt_at[ids] - upto[:-1]).astype(np.int32), sizes) + np.arange(upto[-1], dtype=np.int32)  # a batch is short of 2 GB
        return self.spelt_data[at].tobytes(), upto[bounds]

    def unmarked(self, text: str) -> str:
        """Spaces for markers, without the one before the text."""
        text = text.replace(MARK, " ")
        return text[1:] if self.model.add_dummy_prefix and text.startswith(" ") else text


class _Known:
    """What a task knows of the cuts it has met: for each, the ids, how many are
    byte pieces and whether the library agrees.  Ids lie in one array, so that a
    cut costs a string and a few numbers."""

    def __init__(self, tok: Tokenizer, library, most: int):
        self.tok, self.library, self.most = tok, library, most
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.n_bytes, self.same = np.zeros(0, np.int64), np.zeros(0, bool)

    def meet(self, cuts: list[str]) -> list[int]:
        """Codes of the cuts; those not met before are encoded in one batch."""
        new = list(set(cuts).difference(self.codes))
        for lo in range(0, len(new), 1 << 15):
            self._add(new[lo : lo + (1 << 15)])
        return list(map(self.codes.__getitem__, cuts))

    def _add(self, new: list[str]) -> None:
        tok = self.tok
        parts = []
        if tok.joins:  # no piece spans what lies between these, so they may be encoded in a row
            row = [c for c in new if c[0] == MARK and c[-1] != MARK]
            texts = ["".join(row[k : k + JOIN]) for k in range(0, len(row), JOIN)]
            ours = tok.sized(row, tok.encode_many(texts))
            theirs = tok.sized(row, self.library.encode(_unmarked(texts, tok), num_threads=1))
            if ours is not None and theirs is not None:
                parts.append((row, ours, theirs))
                new = [c for c in new if c[0] != MARK or c[-1] == MARK]
        if new:
            ids = tok.encode_many(new)
            theirs = _theirs(new, ids, self.library.encode(_unmarked(new, tok), num_threads=1), tok)
            parts.append((new, _flat(ids), _flat(theirs)))
        for cuts, (sizes, flat), (their_sizes, their_flat) in parts:
            same = sizes == their_sizes
            their_flat = their_flat[np.repeat(same, their_sizes)]
            differ = np.r_[0, np.cumsum(flat[np.repeat(same, sizes)] != their_flat)]
            upto = np.cumsum(np.where(same, sizes, 0))
            same &= differ[upto] == differ[upto - np.where(same, sizes, 0)]
            of_bytes = np.r_[0, np.cumsum(tok.is_byte[flat])]
            ends = np.cumsum(sizes)
            self.codes.update(zip(cuts, range(len(self.codes), len(self.codes) + len(cuts))))
            self.n_bytes = np.r_[self.n_bytes, of_bytes[ends] - of_bytes[ends - sizes]]
            self.same = np.r_[self.same, same]
            self.ids, self.at = np.r_[self.ids, flat], np.r_[self.at, self.at[-1] + ends]

    def forget(self, code: np.ndarray) -> None:
        """Beyond ``most`` bytes, keep only cuts that this batch met more than once."""
        n = len(self.codes)
        if n * ENTRY_BYTES + 2 * len(self.ids) * 4 <= self.most:
            return
        keep = np.flatnonzero(np.bincount(code, minlength=n) > 1)
        names = list(self.codes)
        sizes = np.diff(self.at)[keep]
        at = np.r_[0, np.cumsum(sizes)]
        self.ids = self.ids[np.repeat(self.at[keep] - at[:-1], sizes) + np.arange(at[-1])]
        self.at, self.n_bytes, self.same = at, self.n_bytes[keep], self.same[keep]
        self.codes = {names[i]: k for k, i in enumerate(keep.tolist())}


_LOADED: dict[str, tuple] = {}


def _loaded(raw: bytes) -> tuple[Tokenizer, _Known]:
    """The tokenizer, and what it was held against the library for; once a worker."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _LOADED:
        import sentencepiece

        tok = Tokenizer(raw)
        _LOADED[key] = (tok, _Known(tok, sentencepiece.SentencePieceProcessor(model_proto=raw), KNOWN_BYTES))
    return _LOADED[key]


#: Bytes of cuts that a task remembers from batch to batch, and what one takes
#: besides its ids.  Results do not depend on either.
KNOWN_BYTES, ENTRY_BYTES = 32 << 20, 210
BATCH_BYTES = 1 << 20
JOIN = 32  # cuts encoded in a row


@B.tidied
def _encode(batches, sent, text_at, schema, decode):
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    tok, known = _loaded(sent.value)
    known.clear()  # of what an earlier task met
    try:
        yield from _encoded(batches, tok, known, text_at, schema, decode)
    finally:
        known.clear()


def _encoded(batches, tok, known, text_at, schema, decode):
    for batch in (part for whole in batches for part in B.pieces(whole, text_at, BATCH_BYTES)):
        texts = [t or "" for t in batch.column(text_at).to_pylist()]
        marked = list(map(tok.marked, texts))
        alike = np.fromiter(map(str.__eq__, marked, known.library.normalize(texts)), bool, len(texts))
        cuts = [tok.cut(m) for m in marked]
        ends = np.r_[0, np.cumsum(np.fromiter(map(len, cuts), np.int64, len(cuts)))]
        codes = known.meet(list(chain.from_iterable(cuts)))
        del cuts, texts
        code = np.array(codes, np.int64)
        # ids of each cut in turn, then bounds of each document among them
        first, size = known.at[code], known.at[code + 1] - known.at[code]
        upto = np.r_[0, np.cumsum(size)]
        ids = known.ids[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])]
        bounds = upto[ends]
        n_bytes = np.diff(np.r_[0, np.cumsum(known.n_bytes[code])][ends])
        differ = np.diff(np.r_[0, np.cumsum(~known.same[code])][ends])
        known.forget(code)
        back, ends = tok.flat_bytes(ids, bounds)
        ok, decoded = [], []
        for m, a, b in zip(marked, ends[:-1].tolist(), ends[1:].tolist()):
            text = back[a:b].decode(errors="each-byte")
            ok.append(text == m)
            if decode:
                decoded.append(tok.unmarked(text))
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
        cols = [*batch.columns, lists, pa.array(np.diff(bounds)), pa.array(n_bytes)]
        cols += [pa.array(decoded, pa.string())] if decode else []
        cols += [pa.array(ok, pa.bool_()), pa.array(alike & (differ == 0))]
        yield pa.RecordBatch.from_arrays(cols, names=schema)


def _unmarked(cuts: list[str], tok: Tokenizer) -> list[str]:
    """What the library must be given so that it sees each cut as it stands: the
    library adds the first marker itself."""
    drop = int(tok.model.add_dummy_prefix)
    before = next(iter(tok.user), "")  # what follows a user-defined piece has no marker
    return [c.replace(MARK, " ")[drop:] if c.startswith(MARK) or not drop else c if c in tok.user else before + c for c in cuts]


def _theirs(cuts: list[str], ids: list[list[int]], found: list[list[int]], tok: Tokenizer) -> list[list[int]]:
    """The library's pieces of each cut itself."""
    if MARK in cuts:  # the library can't be given this part alone
        k = cuts.index(MARK)
        found[k] = [i for i, (p, _, kind) in enumerate(tok.model.pieces) if p == MARK and kind == NORMAL] or ids[k]
    if tok.user and tok.model.add_dummy_prefix:
        for k, cut in enumerate(cuts):
            if not cut.startswith(MARK):  # before it: the first marker, and the piece that it follows
                found[k] = found[k][-len(ids[k]) :]
    return found


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return sizes, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))


def encode(docs: DataFrame, model: bytes, text_col: str = "text", decode: bool = True) -> DataFrame:
    """``docs`` with ids, n_tokens, n_byte_tokens, decoded (if asked), roundtrip
    and parity."""
    docs = without(docs, *ADDED)
    bound_batches(docs.sparkSession)
    names = [c.lower() for c in docs.columns]
    added = [("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("n_byte_tokens", T.LongType())]
    added += [("decoded", T.StringType())] if decode else []
    added += [("roundtrip", T.BooleanType()), ("parity", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in added)])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a model file: megabytes, whatever the corpus
    return docs.mapInArrow(partial(_encode, sent=sent, text_at=names.index(text_col.lower()), schema=schema.names, decode=decode), schema)


@B.tidied
def decode_column(batches, sent, ids_at, schema):
    tok, _ = _loaded(sent.value)
    for batch in batches:
        texts = [tok.decode(x or []) for x in batch.column(ids_at).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema)


def decode(tokens: DataFrame, model: bytes, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its ids."""
    tokens = without(tokens, out)
    schema = T.StructType([*tokens.schema.fields, T.StructField(out, T.StringType())])
    sent = tokens.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in tokens.columns].index(ids_col.lower())
    return tokens.mapInArrow(partial(decode_column, sent=sent, ids_at=at, schema=schema.names), schema)


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()
