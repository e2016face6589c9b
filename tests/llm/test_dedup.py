"""Operators that remove or link repeats, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kvlake.llm import bytesops as B
from kvlake.llm import decontaminate, kd_sharding, line_dedup, ngram_join, suffix_dedup

SCHEMA = "doc_id long, text string, n_lines string"


def texts(seed, n=60):
    """Prose with copies, near copies, shared lines and passages, odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    passage = " ".join(word() for _ in range(80))
    line = "A shared Line of text, again"
    out = []
    for i in range(n):
        ws = [word() for _ in range(rng.choice([3, 8, 40, 150]))]
        t = " ".join(ws)
        k = i % 6
        if k == 1 and out:
            t = out[-1]
        elif k == 2 and out and out[-1]:
            ws = out[-1].split(" ")
            ws[rng.randrange(len(ws))] = word()
            t = " ".join(ws)
        elif k == 3:
            t = t + "\n" + line + " \n" + passage + "\n" + t
        elif k == 4:
            t = f"\t{line.upper()}\r\n{t}\n\nshort\nshort"
        out.append(t)
    return [*out, None, "", " \n\t", "x" * 900, "one two three", "one two three"]


def frame(spark, ts):
    return spark.createDataFrame([(i * 3, t, "other") for i, t in enumerate(ts)], SCHEMA)


@pytest.mark.parametrize("width, hot", [(200, 20_000), (40, 20_000), (40, 3)])
def test_suffix_dedup_matches_brute_force(spark, width, hot):
    for ts in (texts(1), texts(5, 20)):
        raw = [(t or "").encode() for t in ts]
        seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
        out = suffix_dedup.remove_repeats(frame(spark, ts), width=width, gram=16, block=2000, hot=hot)
        got = {r["doc_id"]: r for r in out.collect()}
        for i, b in enumerate(raw):
            hit = [False] * len(b)
            for j in range(len(b) - width + 1):
                if seen[b[j : j + width]] > 1:
                    hit[j : j + width] = [True] * width
            runs = sum(1 for j, h in enumerate(hit) if h and (j == 0 or not hit[j - 1]))
            left = bytes(c for c, h in zip(b, hit) if not h)
            r = got[i * 3]
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(hit), runs, hashlib.sha256(left).hexdigest()), i


def test_suffix_dedup_of_a_boilerplate_that_is_followed_by_other_text(spark):
    """A string of 100 bytes in 20,000 documents is no repeat of 200 bytes."""
    rng = random.Random(2)
    plate = "".join(rng.choice("abcdefgh ") for _ in range(100))
    around = lambda: "".join(rng.choice("ijklmnop ") for _ in range(180))
    ts = [around() + plate + around() for _ in range(20_000)]
    ts += [ts[7]] * 2
    out = suffix_dedup.remove_repeats(frame(spark, ts), hot=5000).where("n_removed > 0")
    assert {(r["doc_id"], r["n_removed"], r["n_spans"]) for r in out.collect()} == {(3 * i, 460, 1) for i in (7, 20_000, 20_001)}


def test_suffix_dedup_of_long_texts(spark):
    """20 MB in one text, with a passage that stands in another text and across a segment's edge."""
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 123, 20 << 20, dtype=np.uint8)
    passage = rng.integers(97, 123, 300, dtype=np.uint8)
    for k, at in enumerate((1000, (3 << 20) - 150, (20 << 20) - 301)):
        raw[at - 1 : at + 301] = np.r_[65 + k, passage, 75 + k]  # what is around differs
    out = suffix_dedup.remove_repeats(frame(spark, [raw.tobytes().decode(), "x" + passage.tobytes().decode(), ""]))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    assert got == {0: (20 << 20, 900, 3), 3: (301, 300, 1), 6: (0, 0, 0)}


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_suffix_sort_settles_collisions_on_bytes(monkeypatch, bits):
    """With hashes of few bits, contexts of different anchors meet and extensions seem longer."""
    real = B.span_hash
    monkeypatch.setattr(B, "span_hash", lambda *a: real(*a) & np.uint64((1 << bits) - 1))
    rng = random.Random(bits)
    for width, gram in ((20, 6), (10, 10), (30, 8)):
        base = ["".join(rng.choice("ab\n") for _ in range(90)) for _ in range(4)]
        raw = ["".join(rng.choice(base)[rng.randrange(20) :][: rng.randrange(90)] + rng.choice("xyz") for _ in range(3)).encode() for _ in range(25)]
        data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        row, first, last, place, h, *_ = suffix_dedup.contexts(data, offs, width, gram)
        rows = [(int(r), 0, int(a), int(f - offs[r]), int(p - f), data[f : e + width].tobytes()) for r, f, e, p, a in zip(row, first, last, place, h.view(np.int64))]
        hit = [np.zeros(len(b), bool) for b in raw]
        for r, _, (s, e) in suffix_dedup._compare_block(sorted(rows, key=lambda x: x[2]), width, gram):
            hit[r][s:e] = True
        seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
        for b, found in zip(raw, hit):
            want = np.zeros(len(b), bool)
            for i in range(len(b) - width + 1):
                if seen[b[i : i + width]] > 1:
                    want[i : i + width] = True
            assert (want == found).all()


def test_suffix_dedup_of_an_empty_table(spark):
    out = suffix_dedup.remove_repeats(frame(spark, ["a"]).where("false"))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"] and out.count() == 0


def test_line_dedup_matches_brute_force(spark):
    ts = texts(2)
    holders = defaultdict(set)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for i, t in enumerate(ts):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    for bits in (1 << 28, 1 << 12):  # a full filter changes nothing
        got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(frame(spark, ts), max_filter_bits=bits).collect()}
        for i, t in enumerate(ts):
            kept = [x for x in (t or "").split("\n") if len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
            assert (got[i * 3]["text"] or "") == "\n".join(kept)
            assert got[i * 3]["n_dropped"] == (t or "").count("\n") + 1 - len(kept) or not kept


def components(ts):
    sets = []
    for t in ts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(ts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("least", [8, 2])  # with 2, nearly all tokens are frequent: pairs carry the join
def test_ngram_join_matches_brute_force(spark, least):
    ts = texts(3, 90)
    want = components(ts)
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(frame(spark, ts), share=0.0, least=least).collect()}
    assert {i: (got[i * 3]["n_shingles"], got[i * 3]["component_id"] // 3) for i in range(len(ts))} == dict(enumerate(want))


@pytest.mark.parametrize("before", [0, 8])
def test_ngram_join_of_a_cluster_with_near_misses(spark, monkeypatch, before):
    """Copies of one text with more and more edits: many share signatures and don't link."""
    monkeypatch.setattr(ngram_join, "BEFORE", before)
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    ts = []
    for i in range(120):
        ws = list(base)
        for _ in range(rng.randrange(1, 9)):
            ws[rng.randrange(len(ws))] = f"e{i}x{rng.randrange(10**6)}"
        ts.append(" ".join(ws))
    ts += ts[:5] + ["", None, " ".join(base[:100]), " ".join(base)]
    rng.shuffle(ts)
    want = components(ts)
    assert 3 < len({root for _, root in want}) < 100
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(frame(spark, ts)).collect()}
    assert {i: (got[i * 3]["n_shingles"], got[i * 3]["component_id"] // 3) for i in range(len(ts))} == dict(enumerate(want))


def test_ngram_join_tells_words_of_equal_polynomial_hashes_apart(spark):
    """A Thue-Morse word and its complement collide modulo any power of two."""
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = bits.translate(str.maketrans("ab", "ba"))
    ts = [" ".join([bits] * 4 + ["end"]), " ".join([other] * 4 + ["end"]), " ".join([bits, other] * 3), " ".join([bits.upper()] * 4 + ["END"])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, ts)).collect()}
    assert got == {0: (1, 0), 3: (1, 3), 6: (2, 6), 9: (1, 0)}


def test_ngram_join_keeps_links_of_an_id_with_several_texts(spark):
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    a = words("a", 104)
    ts = [" ".join(a), " ".join(words("b", 104)), " ".join(a[:94] + words("c", 10)), " ".join(a[90:] + words("d", 100))]
    want = components(ts)
    assert [root for _, root in want] == [0, 1, 0, 3]
    # the first two texts are one document; all shingles of the first are in another text too, none of the second
    df = spark.createDataFrame(list(zip([0, 0, 2, 3], ts)), "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(df, share=0.0, least=2).collect()}
    assert got == {(0, 0), (2, 0), (3, 3)}


def test_decontamination_blocks_and_short_items(spark):
    rng = random.Random(4)
    ws = lambda n: [rng.choice("abc") + str(rng.randrange(9)) for _ in range(n)]
    items = [(str(i), " ".join(ws(n))) for i, n in enumerate([30, 20, 13, 5, 1, 40])] + [("x", "--"), ("n", None)]
    docs = [" ".join(ws(10)) + " " + (items[i % 6][1]).upper() + "; " + " ".join(ws(20)) for i in range(12)] + ["zz " * 400 + items[0][1], None, "", "é"]

    def brute(t):
        w = decontaminate.tokens(t)
        hit, found = set(), set()
        for name, text in items:
            v = decontaminate.tokens(text)
            n = min(13, len(v))
            for j in range(len(v) - n + 1 if v else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[j : j + n]:
                        hit.update(range(i, i + n))
                        found.add(name)
        return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)

    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (10**6, 40):
        out = decontaminate.find_contamination(frame(spark, docs), bench, block_words=block)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["hit_items"]), r["contaminated"]) for r in out.collect()}
        assert [got[i * 3] for i in range(len(docs))] == [brute(t) for t in docs]
    left = decontaminate.remove_contamination(frame(spark, docs), bench).collect()
    assert {r["doc_id"] // 3 for r in left} == {i for i, t in enumerate(docs) if not brute(t)[3]}


def test_sharding_matches_a_tree_built_in_one_place(spark):
    """Brute force: the same splits over a list, each at the value nearest the share."""
    rng = random.Random(8)
    rows = [(i, "x" * rng.randrange(200), rng.randrange(10**6), float(rng.randrange(500))) for i in range(400)]
    out = kd_sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, a long, b double"), ["a", "b"], n_shards=8, tolerance=0.0).collect()
    size = {r["doc_id"]: r["size"] for r in out}
    code = {i: (a, int(b), math.floor(math.log2(size[i]) * 64)) for i, _, a, b in rows}
    span = [max(1, max(c[d] for c in code.values()) - min(c[d] for c in code.values())) for d in range(3)]
    got = {r["doc_id"]: r["shard"] for r in out}

    def check(ids, first, shards):
        assert {got[i] for i in ids} == set(range(first, first + shards))
        if shards == 1:
            return
        wide = [(max(code[i][d] for i in ids) - min(code[i][d] for i in ids)) / span[d] for d in range(3)]
        d = wide.index(max(wide))
        left = [i for i in ids if got[i] < first + shards // 2]
        right = [i for i in ids if got[i] >= first + shards // 2]
        assert max(code[i][d] for i in left) <= min(code[i][d] for i in right)
        target = sum(size[i] for i in ids) * (shards // 2) / shards
        edge = max(size[i] for i in ids if code[i][d] == max(code[j][d] for j in left) or code[i][d] == min(code[j][d] for j in right))
        assert abs(sum(size[i] for i in left) - target) <= edge
        check(left, first, shards // 2)
        check(right, first + shards // 2, shards - shards // 2)

    check([r[0] for r in rows], 0, 8)


def test_sharding_is_near_equal_and_gapless(spark):
    ts = texts(5, 200) * 2
    df = frame(spark, ts).withColumnRenamed("n_lines", "source")
    rows = kd_sharding.shard(df, ["doc_id", "source"], n_shards=8, bins=16).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert len(rows) == len(ts) and set(by) == set(range(8)) and max(sizes) - min(sizes) <= 4 * max(r["size"] for r in rows)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    same = spark.createDataFrame([(1, "a", "s")] * 80, "doc_id long, text string, source string")
    assert max(Counter(r["shard"] for r in kd_sharding.shard(same, ["source"], n_shards=4).collect()).values()) <= 40


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert ngram_join.near_duplicates(none).count() == 0
    assert kd_sharding.shard(none, ["doc_id"], n_shards=8).count() == 0
    bench = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.find_contamination(frame(spark, ["a b"]), bench).first()["n_hit"] == 0


def test_short_sets_never_lose_a_link():
    rng = np.random.default_rng(5)
    for n in [0, 1, 2, 7, 63, 64, 200, 5000] * 5:
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 2**64, n // 8, dtype=np.uint64)])
        x, y = (ngram_join.lengthen(ngram_join.shorten(s)) for s in (a, b))
        assert np.array_equal(x[0], (a >> np.uint64(64 - x[1])).astype(np.int64))
        assert ngram_join.may_be_linked(x, y, 75) or not ngram_join.linked(a, b, 75)
    far = ngram_join.lengthen(ngram_join.shorten(np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))))
    assert not ngram_join.may_be_linked(x, far, 75)
