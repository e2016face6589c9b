"""N-gram Jaccard join with token-combination prefixes.

A document's set holds its distinct word shingles, as 64-bit hashes ("tokens").
Two sets link at Jaccard similarity >= ``percent`` / 100.  Linked sets miss at
most ``floor(n * (100 - percent) / 100)`` tokens of a set of n.

*Order and classes.*  Tokens are put in one global order: rare ones first (by
hash), then the frequent ones.  Which tokens are frequent is found by a first
pass over all documents: counts of those that are common within a batch, added
up, of which at most ``max_frequent`` are kept and sent to all tasks.

*Prefixes.*  A prefix is extended until (rare tokens) + (frequent tokens - 1)
exceeds the tokens that may miss, the frequent ones counted by classes.  Linked
sets then share, in their prefixes, a rare token or two frequent ones of a
class; so rare tokens are indexed singly and frequent ones by pairs.  The set
whose prefix ends first misses at most that many of its prefix tokens, and every
token it shares lies in the other's prefix too.

*Index.*  Signatures travel in blocks of arrays, cut into slices by hash, and
are matched by a sort within each slice.  A batch sends one posting per
signature and chains its own repeats to it, so a hot signature is no one
slice's load.

*Verify.*  Equal sets are one set from the start: they are one class, whatever
its size.  Of a signature's sets, each is first held against one pivot, the one
with the least share of tokens that no other set has; then
components are formed, and only signatures whose sets are still in different
components are looked at again, with a new pivot, until none is left.  Pairs
within a component can't change it, so no link that matters is lost and a group
of m copies costs about m pairs instead of m * m.  Two sets that share many open
signatures meet at the smallest: a posting carries the ``BEFORE`` open signatures
of its set before it, and a pair that shares one of those is left to it.  A pair
is held against sketches of fixed size, then against short forms of about a byte a
token, which never lose a link, and only what they leave is settled by the sets
themselves.

Defined results: with fewer words than a shingle the whole sequence is the one
token; a null or empty text, or one without words, has an empty set and is
linked with nothing.  A null doc_id takes no part and is its own (null) class.
Rows of one doc_id are one document with several texts; its class is that of
all of them.  Ids are integers.  A very long text is one set.  Words of more than
``LONG_WORD`` bytes are told apart by a digest, others by a polynomial hash.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.llm import bytesops as B
from kvlake.llm.common import bound_batches, discard, parts_for, store
from kvlake.llm.components import connected_components

WORDS = 5
PERCENT = 75
MAX_FREQUENT = 1 << 16
FREQUENT_SHARE = 1 / 200  # of a batch's documents
_U = np.uint64
MAX_BROADCAST = 500_000  # ids, 4 MB
BEFORE = 8
LONG_WORD = 64
SKETCH = 16  # longs
BITS = [f"s{i}" for i in range(SKETCH)]
CHAINED, COUNTS = -1, -(1 << 40)  # kinds of blocks beside the slices


def shingle_hashes(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each row, sorted by (row, hash), and their row bounds."""
    start, end, per_row = B.words(data, offs)
    if not len(start):
        return np.zeros(0, _U), np.zeros(len(offs), np.int64)
    h = B.span_hash(B.prefix_hash(data, B.VALUES_LOWER), start, end)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():  # long words can be made to collide
        word = data[start[i] : end[i]].tobytes().lower()
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    first = np.cumsum(per_row) - per_row
    tokens = np.maximum(per_row - k + 1, (per_row > 0).astype(np.int64))
    row = np.repeat(np.arange(len(per_row)), tokens)
    at = np.arange(len(row)) - np.repeat(np.cumsum(tokens) - tokens, tokens) + first[row]
    padded = np.concatenate([h, np.zeros(k, _U)])
    limit = (first + per_row)[row]
    out = np.zeros(len(row), _U)
    for j in range(k):
        part = B.mix(padded[at + j] + _U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        part[at + j >= limit] = _U(0)
        out = out * _U(0xD6E8FEB86659FD93) + part
    out = B.mix(out)
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.r_[True, (out[1:] != out[:-1]) | (row[1:] != row[:-1])]
    return out[new], np.searchsorted(row[new], np.arange(len(offs)))


@B.tidied
def _sets(batches, k, text_at):
    """(id, digest of the set, size, sketch) of each row.

    The sketch sets one of 1024 bits for each token.  Bits that one set has and
    the other lacks are tokens it does not share: a bound without false negatives."""
    for batch in batches:
        sizes, digests, sketches = [], [], []
        for lo, hi, data, offs in B.chunks(batch.column(text_at)):
            h, at = shingle_hashes(data, offs, k)
            sizes.append(np.diff(at))
            digests += [hashlib.blake2b(h[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:])]
            bits = np.zeros((hi - lo, SKETCH * 64), np.uint8)
            bits[np.repeat(np.arange(hi - lo), np.diff(at)), (h >> _U(20)).astype(np.int64) % (SKETCH * 64)] = 1
            sketches.append(np.packbits(bits, axis=1).view(np.int64))
        n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        s = np.concatenate(sketches) if sketches else np.zeros((0, SKETCH), np.int64)
        cols = [batch.column(0), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), *[pa.array(np.ascontiguousarray(s[:, i])) for i in range(SKETCH)]]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "digest", "n", *BITS])


@B.tidied
def _common_tokens(batches, k, share, least):
    """Tokens in more than ``share`` of a batch's rows (and in ``least`` at least), with counts."""
    for batch in (part for whole in batches for part in B.pieces(whole, 1)):
        hs = [shingle_hashes(data, offs, k)[0] for _, _, data, offs in B.chunks(batch.column(1))]
        h, n = np.unique(np.concatenate(hs) if hs else np.zeros(0, _U), return_counts=True)
        often = n >= max(least, share * batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often], pa.int64())], names=["token", "n"])


def _pairs(tokens: np.ndarray, classes: int, rare: int, miss: int) -> np.ndarray:
    """Pair signatures of the shortest prefix of frequent tokens that will do.

    Frequent tokens fall into ``classes`` by hash and are paired within a class;
    all but one of a class's tokens count towards what may miss.
    """
    kind = (B.mix(tokens) % _U(classes)).astype(np.int64)
    _, first = np.unique(kind, return_index=True)
    counts = np.ones(len(tokens), np.int64)
    counts[first] = 0
    end = int(np.searchsorted(np.cumsum(counts), miss + 1 - rare)) + 1
    tokens, kind = tokens[:end], kind[:end]
    order = np.argsort(kind, kind="stable")
    tokens, kind = tokens[order], kind[order]
    out, d = [], 1
    while d < len(kind):
        same = kind[d:] == kind[:-d]
        if not same.any():
            break
        out.append(B.mix(tokens[:-d][same] * _U(0xA24BAED4963EE407) + tokens[d:][same] + _U(classes)))
        d += 1
    return np.concatenate(out) if out else np.zeros(0, _U)


def schemes(n: int, percent: int) -> list[int]:
    """Class counts under which a set of n is paired: by its size's power of two,
    and by that of sizes it could link to, so that linked sets share one."""
    low, high = -(-n * percent // 100), n * 100 // percent
    return sorted({max(1, (1 << (m.bit_length() - 1)) // 8) for m in (max(low, 1), n, high)})


def prefix_signatures(h: np.ndarray, at: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of each row's extended prefix: (signature, row).  The lowest bit
    tells pairs from rare tokens."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    miss = n * (100 - percent) // 100
    often = np.zeros(len(h), bool)
    if len(frequent) and len(h):
        near = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        often = frequent[near] == h
    n_rare = n - np.bincount(row[often], minlength=len(n))
    # rare tokens, already by hash within each row
    rare_h, rare_row = h[~often], row[~often]
    rank = np.arange(len(rare_h)) - (np.cumsum(n_rare) - n_rare)[rare_row]
    take = rank <= miss[rare_row]
    sigs, rows = [rare_h[take] & ~_U(1)], [rare_row[take]]
    # rows whose rare tokens do not suffice take frequent ones, in pairs
    for r in np.flatnonzero((n_rare <= miss) & (n > n_rare + 1)).tolist():
        f = h[at[r] : at[r + 1]][often[at[r] : at[r + 1]]]
        for classes in schemes(int(n[r]), percent):
            s = _pairs(f, classes, int(n_rare[r]), int(miss[r]))
            sigs.append(s | _U(1))
            rows.append(np.full(len(s), r))
    return np.concatenate(sigs), np.concatenate(rows)


@B.tidied
def _postings(batches, k, frequent, percent, slices):
    """Signatures in slices, one posting per batch and signature; the batch's
    other postings are chained to that one as ready (signature, id) rows."""
    shift = _U(64 - slices.bit_length() + 1)
    often = frequent.value
    for batch in (part for whole in batches for part in B.pieces(whole, 1)):
        ids, sigs, who = batch.column(0).to_numpy(), [], []
        n_rare = np.zeros(batch.num_rows, np.int64)
        for lo, hi, data, offs in B.chunks(batch.column(1)):
            h, at = shingle_hashes(data, offs, k)
            first: dict[bytes, int] = {}  # of copies, only the smallest id can stand for them
            for r in range(hi - lo):
                key = hashlib.blake2b(h[at[r] : at[r + 1]], digest_size=16).digest()
                if key not in first or ids[lo + r] < ids[lo + first[key]]:
                    first[key] = r
            own = np.zeros(hi - lo, bool)
            own[list(first.values())] = True
            n = np.diff(at)
            s, r = prefix_signatures(h[np.repeat(own, n)], np.r_[0, np.cumsum(np.where(own, n, 0))], often, percent)
            sigs.append(s)
            who.append(ids[lo + r])
            n_rare[lo:hi] = np.bincount(r[s & _U(1) == 0], minlength=hi - lo)
        s = np.concatenate(sigs) if sigs else np.zeros(0, _U)
        d = np.concatenate(who) if who else np.zeros(0, np.int64)
        order = np.argsort(s, kind="stable")
        s, d = s[order], d[order]
        if not len(s):
            continue
        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        many = np.diff(np.r_[head, len(s)]) > 1
        repeated = np.repeat(many, np.diff(np.r_[head, len(s)]))
        tail = repeated.copy()
        tail[head] = False
        out_s, out_d = s[head], d[head]
        cut = (out_s >> shift).astype(np.int64)
        kinds, first = np.unique(cut, return_index=True)
        bounds = np.r_[first, len(out_s)]
        flag = many.astype(np.uint8)
        blobs = [out_s[a:b].tobytes() + out_d[a:b].tobytes() + flag[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        chained = s[tail].tobytes() + d[tail].tobytes()
        some = n_rare > 0
        counts = n_rare[some].tobytes() + ids[some].tobytes()
        any_ = int(s[0] % _U(1 << 30))
        yield pa.RecordBatch.from_arrays(
            [pa.array([*kinds.tolist(), CHAINED - any_, COUNTS - any_], pa.int64()), pa.array([*blobs, chained, counts], pa.binary())],
            names=["slice", "blob"],
        )


def _matches(key, table: pa.Table):
    """Postings of signatures found more than once: (sig, id).  Also, for each
    set with rare tokens in its prefix, how many: (null, id, n_rare)."""
    blobs, kind = [b.as_py() for b in table.column("blob")], key[0].as_py()
    if kind < 0:  # chained rows are known repeats
        s = np.concatenate([np.frombuffer(b, np.int64, len(b) // 16) for b in blobs])
        d = np.concatenate([np.frombuffer(b, np.int64, offset=len(b) // 2) for b in blobs])
        none = pa.nulls(len(s), pa.int64())
        return pa.table({"sig": none if kind <= COUNTS else pa.array(s), "id": pa.array(d), "n_rare": pa.array(s) if kind <= COUNTS else none})
    ns = [len(b) // 17 for b in blobs]
    s = np.concatenate([np.frombuffer(b, _U, n) for b, n in zip(blobs, ns)])
    d = np.concatenate([np.frombuffer(b, np.int64, n, 8 * n) for b, n in zip(blobs, ns)])
    f = np.concatenate([np.frombuffer(b, np.uint8, n, 16 * n) for b, n in zip(blobs, ns)])
    order = np.argsort(s, kind="stable")
    s, d, f = s[order], d[order], f[order] > 0
    same = s[1:] == s[:-1]
    keep = f | np.r_[False, same] | np.r_[same, False]
    return pa.table({"sig": pa.array(s[keep].view(np.int64)), "id": pa.array(d[keep]), "n_rare": pa.nulls(int(keep.sum()), pa.int64())})


def shorten(h: np.ndarray) -> bytes:
    """The leading bits of a sorted set's tokens, as differences of a byte each
    (255: add it and go on).  A set of n has 64 n to 128 n possible values."""
    v = (h >> _U(64 - _short_bits(len(h)))).astype(np.int64)
    d = np.diff(v, prepend=0)
    more = d // 255
    out = np.full(len(d) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = d % 255
    return len(h).to_bytes(8, "little") + out.tobytes()


def _short_bits(n: int) -> int:
    return n.bit_length() + 6


def lengthen(short: bytes | pa.Buffer) -> tuple[np.ndarray, int]:
    """What ``shorten`` kept: leading bits, sorted, and how many bits they are."""
    n = int(np.frombuffer(short, np.int64, 1)[0])
    d = np.frombuffer(short, np.uint8, offset=8)
    return np.cumsum(d, dtype=np.int64)[d != 255], _short_bits(n)


@B.tidied
def _packed_sets(batches, k):
    """(id, tokens as bytes, their short form) of each row."""
    for batch in batches:
        blobs, shorts = [], []
        for _, _, data, offs in B.chunks(batch.column(1)):
            h, at = shingle_hashes(data, offs, k)
            blobs += [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            shorts += [shorten(h[a:b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), pa.array(shorts, pa.binary())], names=["id", "tokens", "short"])


def _unpack(tokens: pa.Buffer) -> np.ndarray:
    return np.frombuffer(tokens, _U)


def _inside(a: np.ndarray, b: np.ndarray) -> int:
    """How many of b are in a, which is sorted."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum()) if len(a) else 0


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    both = _inside(a, b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def may_be_linked(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int], percent: int) -> bool:
    """Whether sets of these short forms can link: equal tokens have equal leading
    bits, so no more tokens are shared than agree in them."""
    (x, x_bits), (y, y_bits) = a, b
    bits = min(x_bits, y_bits)
    x, y = x >> (x_bits - bits), y >> (y_bits - bits)
    return min(_inside(x, y), _inside(y, x)) * (100 + percent) >= percent * (len(x) + len(y))


@B.tidied
def _verify(batches, unpack, test, percent):
    """Pairs that pass the test; the pivot's set is unpacked once for a run of pairs."""
    for batch in batches:
        pivots, members = batch.column("pset"), batch.column("mset")
        keep, last, mine = np.zeros(batch.num_rows, bool), None, None
        for i in range(batch.num_rows):
            own = pivots[i].as_buffer()
            if last is None or not own.equals(last):
                last, mine = own, unpack(own)
            keep[i] = test(mine, unpack(members[i].as_buffer()), percent)
        yield pa.RecordBatch.from_arrays([batch.column("pivot").filter(pa.array(keep)), batch.column("member").filter(pa.array(keep))], names=["pivot", "member"])


def _may_link(a: str, b: str, percent: int):
    """Sizes, and the tokens that may be shared at most, allow a link."""
    sizes = (F.col(f"{a}.hi") * 100 >= F.col(f"{b}.lo") * percent) & (F.col(f"{b}.hi") * 100 >= F.col(f"{a}.lo") * percent)
    return sizes & (F.least(f"{a}.most", f"{b}.most") * (100 + percent) >= (F.col(f"{a}.lo") + F.col(f"{b}.lo")) * percent)


def _sketch_allows(a: str, b: str, percent: int):
    """The sketches, where both sets have one, allow a link."""

    def shared(x, y):  # at most so many of x's tokens are in y
        lacks = sum((F.bit_count(F.col(f"{x}.{s}").bitwiseAND(F.bitwise_not(f"{y}.{s}"))) for s in BITS[1:]), F.bit_count(F.col(f"{x}.s0").bitwiseAND(F.bitwise_not(f"{y}.s0"))))
        return F.col(f"{x}.n") - lacks

    enough = F.least(shared(a, b), shared(b, a)) * (100 + percent) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * percent
    return F.coalesce(enough, F.lit(True))


def _candidates(open_: DataFrame, pivots: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, pivot rows): each signature's ``pivots`` sets of the least share of
    tokens that no other has, against its others of different components."""
    rank = F.row_number().over(Window.partitionBy("sig").orderBy((F.col("hi") - F.col("most")) / F.col("hi"), "id"))
    heads = open_.withColumn("rank", rank).where(F.col("rank") <= pivots).drop("rank")
    differ = (F.col("m.sig") == F.col("p.sig")) & (F.col("m.id") != F.col("p.id")) & (F.col("m.component") != F.col("p.component"))
    may = _may_link("p", "m", percent)
    if "s0" in open_.columns:
        may = may & _sketch_allows("p", "m", percent)
    if "before" in open_.columns:  # pairs that share an earlier signature meet there
        may = may & ~F.arrays_overlap("m.before", "p.before")
    pairs = open_.alias("m").join(heads.alias("p"), differ & may)
    return pairs.select(F.least("p.id", "m.id").alias("pivot"), F.greatest("p.id", "m.id").alias("member")), heads.select("sig", "id")


def _checked(pairs: DataFrame, sets: DataFrame, form: str, unpack, test, percent: int) -> DataFrame:
    """Those of the pairs whose sets, in this form, pass the test."""
    with_member = pairs.join(sets.select(F.col("id").alias("member"), F.col(form).alias("mset")), "member")
    both = with_member.join(sets.select(F.col("id").alias("pivot"), F.col(form).alias("pset")), "pivot")
    passed = both.select("pivot", "member", "pset", "mset").mapInArrow(partial(_verify, unpack=unpack, test=test, percent=percent), "pivot long, member long")
    return passed.distinct()


def _few(ids: DataFrame) -> DataFrame:
    """Ids, sent to all tasks if they are few; else rows are shuffled to them."""
    ids = store(ids)
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids


def _ends(pairs: DataFrame) -> DataFrame:
    """The ids in pairs."""
    return _few(pairs.select(F.col("pivot").alias("id")).unionByName(pairs.select(F.col("member").alias("id"))).distinct())


def _relabel(open_: DataFrame, label: DataFrame) -> DataFrame:
    """Postings with their components, of signatures that still have several."""
    rows = open_.drop("component", "before").join(label, "id")
    columns = rows.columns
    several = rows.groupBy("sig").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n"), *[F.sum(F.xxhash64(F.lit(i), "id").cast("decimal(20,0)")).alias(f"h{i}") for i in range(2)]
    ).where("a < b")
    # signatures of the same sets lead to the same pairs
    several = several.groupBy("n", "h0", "h1").agg(F.min("sig").alias("sig")).select("sig")
    before = F.collect_list("sig").over(Window.partitionBy("id").orderBy("sig").rowsBetween(-BEFORE, -1))
    return rows.join(several, "sig", "left_semi").select(*columns, before.alias("before"))


def _next(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new``, stored in place of the table it is made of."""
    out = store(new)
    discard(old)
    return out


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    out = _next(label, connected_components(label, links))
    discard(links)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT, max_frequent: int = MAX_FREQUENT, share: float = FREQUENT_SHARE, least: int = 8) -> DataFrame:
    """A row per row of ``docs``: the id, n_shingles and component_id (the
    smallest id reachable by links)."""
    spark = docs.sparkSession
    bound_batches(spark)
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sets = store(narrow.mapInArrow(partial(_sets, k=k, text_at=1), "id long, digest binary, n long, " + ", ".join(f"{s} long" for s in BITS)))
    # a set's sketch; ids with several sets have none
    one = F.min("digest") == F.max("digest")
    sketches = sets.where("id is not null and n > 0").groupBy("id").agg(*[F.when(one, F.max(c)).alias(c) for c in ("n", *BITS)])
    known = narrow.where("id is not null")
    # equal sets: the smallest id stands for all
    classes = sets.where("id is not null and n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    reps = store(classes.groupBy(F.col("rep").alias("id")).agg(F.min("n").alias("lo"), F.max("n").alias("hi")))

    counted = known.mapInArrow(partial(_common_tokens, k=k, share=share, least=least), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.col("n").desc(), "token").limit(max_frequent).collect()  # bounded by max_frequent
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r["token"] for r in top], np.int64).view(_U)))

    def checked(pairs: DataFrame) -> DataFrame:
        asked = sketches.join(_ends(pairs), "id", "left_semi")
        m, p = asked.alias("m"), asked.alias("p")
        both = pairs.join(m, F.col("member") == F.col("m.id")).join(p, (F.col("pivot") == F.col("p.id")) & _sketch_allows("p", "m", percent))
        left = store(both.select("pivot", "member"))
        sets = store(known.join(_ends(left), "id", "left_semi").mapInArrow(partial(_packed_sets, k=k), "id long, tokens binary, short binary"))
        close = store(_checked(left, sets, "short", lengthen, may_be_linked, percent))
        # most sets are in no pair by now
        done = store(_checked(close, sets.join(_ends(close), "id", "left_semi"), "tokens", _unpack, linked, percent))
        discard(left, sets, close)
        return done

    slices = parts_for(docs)
    blocks = known.mapInArrow(partial(_postings, k=k, frequent=frequent, percent=percent, slices=slices), "slice long, blob binary")
    matched = store(blocks.groupBy("slice").applyInArrow(lambda key, table: _matches(key, table), "sig long, id long, n_rare long"))
    # postings of copies go; of what is left, signatures of several sets count
    postings = matched.where("sig is not null").select("sig", "id").join(reps, "id").select("sig", "id")
    several = postings.groupBy("sig").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("sig")
    postings = store(postings.join(several, "sig", "left_semi"))
    # a rare token of a prefix that no other set has can't be shared
    shared = postings.where(F.col("sig").bitwiseAND(F.lit(1)) == 0).groupBy("id").agg(F.count("*").alias("c"))
    rare = matched.where("sig is null").groupBy("id").agg(F.max("n_rare").alias("r"))
    # of an id with several rows, the tokens may be another row's, which says nothing of this one
    rows = sets.where("id is not null and n > 0").groupBy("id").agg(F.count("*").alias("k")).where("k > 1")
    most = F.when(F.col("k") > 1, F.col("hi")).otherwise(F.col("hi") - F.greatest(F.coalesce("r", F.lit(0)) - F.coalesce("c", F.lit(0)), F.lit(0)))
    label = store(postings.select("id").distinct().withColumn("component", F.col("id")))
    bounds = label.join(reps, "id").join(rare, "id", "left").join(rows, "id", "left").join(shared, "id", "left").select("id", "component", "lo", "hi", most.alias("most"))
    open_ = store(postings.join(bounds, "id"))
    discard(matched, postings, reps)
    # first, each set against the one pivot with which it shares most signatures
    pairs, _ = _candidates(open_, 1, percent)
    shared = pairs.groupBy("pivot", "member").agg(F.count("*").alias("n"))
    best = store(shared.groupBy("member").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot")))
    label = _joined(label, checked(best))
    open_, pivots = _next(open_, _relabel(open_, label)), 16
    while not open_.isEmpty():
        if pivots > 16 and "s0" not in open_.columns:  # the signatures left have many sets each
            open_ = _next(open_, open_.join(sketches, "id"))
        pairs, heads = _candidates(open_, pivots, percent)
        pairs = store(pairs.distinct())
        label = _joined(label, checked(pairs))
        # these pivots have met all others of their signatures
        open_ = _next(open_, _relabel(open_.join(heads, ["sig", "id"], "left_anti"), label))
        discard(pairs)
        pivots *= 16
    found = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = sets.select("id", "digest", "n").join(found, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id.
    Rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, **how).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_nj_id")).distinct()
    return docs.join(found, docs[f"`{id_col}`"].cast("long") == F.col("_nj_id"), "left_anti")
