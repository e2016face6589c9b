"""The corpus pipeline, each stage against brute force on its own input; very long texts."""

import os
import random
import re

import pytest

import corpus_pipeline
from kvlake.llm import decontaminate, kd_sharding, line_dedup, ngram_join, pii, quality, sentencepiece, toxicity

needs_model = pytest.mark.skipif(not os.path.exists(sentencepiece.MODEL_PATH), reason="no model file")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def write_tables(spark, folder):
    """Clean prose with repeated lines, copies, near copies, benchmark passages and junk."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(f"q{i}", prose(40)) for i in range(3)]
    texts = [prose(rng.randrange(60, 90)) + ("\n" + prose(30) if i % 4 == 3 else "") for i in range(60)]
    for i in range(0, 40, 4):
        texts[i] += "\nThe same Line in many texts, again"
        texts[i + 1] = texts[i]  # a copy, of which no line stays
        ws = texts[i].split(" ")
        ws[5] = word()
        texts[i + 2] = " ".join(ws)
    texts[50] += " " + items[0][1]  # contaminated
    texts[51] += " " + prose(400)
    texts[52] = prose(900) + " " + " ".join(items[2][1].split()[:14]) + " " + prose(9)  # a span only
    junk = ["too short", None, "", "again and again " * 60]
    rows = [(i * 7, t, "en", "web", len(t or "")) for i, t in enumerate([*texts, *junk])]
    rows.append((None, prose(70), None, None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def keep_quality(rows):
    def failed(text):
        w = (text or "").split()
        seen = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        return len(w) < 20 or 100 * len(hit) > 30 * len(w)

    return [(i, t) for i, t in rows if not failed(t)]


def drop_lines(rows):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        if i is not None:
            for x in t.split("\n"):
                holders.setdefault(key(x), set()).add(i)
    stays = lambda i, x: i is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i
    return [(i, "\n".join(x for x in t.split("\n") if stays(i, x))) for i, t in rows]


def one_of_each(rows):
    sets = {}
    for i, t in rows:
        w = lower(t).split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets if i is not None}
    for _ in label:  # labels spread until nothing changes
        for a in label:
            for b in label:
                if label[b] < label[a] and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b]
    return [(i, t) for i, t in rows if i is None or label[i] == i]


def clean_of(rows, items):
    out = []
    for i, t in rows:
        at = [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9a-z\x80-\U0010ffff]+", lower(t))]
        w, hit = [x for *_, x in at], set()
        for _, text in items:
            v = re.findall("[0-9a-z]+", text)
            for a in range(len(v) - 12):
                for b in range(len(w) - 12):
                    if w[b : b + 13] == v[a : a + 13]:
                        hit.update(range(b, b + 13))
        if hit and 20 * len(hit) >= len(w):
            continue
        runs = [(a, max(b for b in range(a, len(w)) if set(range(a, b + 1)) <= hit)) for a in sorted(hit) if a - 1 not in hit]
        for a, b in reversed(runs):
            t = t[: at[a][0]] + t[at[b][1] :]
        out.append((i, t))
    return out


@needs_model
def test_stages_match_brute_force(spark, tmp_path):
    import sentencepiece as library

    items = write_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    brute = [keep_quality, drop_lines, one_of_each, lambda rows: clean_of(rows, items)]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute):
        out = corpus_pipeline.store(stage(spark, docs, str(tmp_path)))
        assert out.columns == corpus_pipeline.COLUMNS
        assert order(rows_of(out)) == order(want(rows_of(docs))), name
        assert out.count() < docs.count() or name == "line dedup"
        docs = out
    done = corpus_pipeline.run(spark, str(tmp_path))
    own = library.SentencePieceProcessor(model_file=sentencepiece.MODEL_PATH)
    got = [(r["doc_id"], r["ids"], r["n_tokens"], r["roundtrip"], r["parity"]) for r in done.collect()]
    assert sorted(got, key=str) == sorted(((i, own.encode(t), len(own.encode(t)), True, True) for i, t in rows_of(docs)), key=str)


@needs_model
def test_an_empty_corpus(spark, tmp_path):
    write_tables(spark, tmp_path / "full")
    spark.read.parquet(f"{tmp_path}/full/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/full/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


LONG = "Some words of a very long text, line 123\n" * 20_000 + "".join(f"w{i} " for i in range(2_250_000))  # 20 MB


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(1, LONG, "en", "web"), (2, "short text " * 9, "en", "web"), (3, None, None, None), (4, LONG, "en", "web")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_long_texts_in_the_join(spark, long_docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(long_docs).collect()}
    w = lower(LONG).split()
    n = len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert got == {1: (n, 1), 2: (2, 2), 3: (0, 3), 4: (n, 1)}


def test_long_texts_in_line_dedup(spark, long_docs):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_repeated_lines(long_docs).select("doc_id", "n_lines", "n_dropped").collect()}
    assert got == {1: (20_001, 0), 2: (1, 0), 3: (1, 0), 4: (20_001, 20_001)}


def test_long_texts_in_decontamination(spark, long_docs):
    bench = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(1_000_000, 1_000_020)))], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["contaminated"]) for r in decontaminate.find_contamination(long_docs, bench).select("doc_id", "n_hit", "contaminated").collect()}
    assert got == {1: (20, False), 2: (0, False), 3: (0, False), 4: (20, False)}


@needs_model
def test_long_texts_in_tokens(spark, long_docs):
    out = sentencepiece.encode(long_docs.where("doc_id < 4"), sentencepiece.read_model(), decode=False).select("doc_id", "n_tokens", "roundtrip", "parity")
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["n_tokens"] > 10_000_000 and all(r["roundtrip"] and r["parity"] for r in got.values())


def test_long_texts_in_sharding_and_scores(spark, long_docs):
    out = kd_sharding.shard(long_docs, ["doc_id", "lang"], n_shards=2).collect()
    assert sorted(r["size"] for r in out) == [1, 100, len(LONG) + 1, len(LONG) + 1]
    assert len({r["shard"] for r in out if r["size"] > 100}) == 2
    none = toxicity.fit(long_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(long_docs, none).where("score > 0.1").count() == 0


def test_long_texts_in_pseudonyms_and_quality(spark, long_docs):
    text = LONG[:4_000_000] + " mail a.b@c.org"
    df = spark.createDataFrame([(1, text, "en", "web"), (2, None, None, None)], long_docs.schema)
    (r,) = pii.pseudonymise(df.where("doc_id = 1"), "k").collect()
    assert r["n_emails"] == 1 and len(r["text"]) == len(text)
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert got[1]["n_words"] == len(text.split()) and got[1]["n_dup_lines"] == 19_999 and not got[2]["kept"]
