"""Queries opN_<name> over the given tables, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvlake.llm import chat, decontaminate, kd_sharding, line_dedup, ngram_join, pii, quality, sentencepiece, suffix_dedup, toxicity


def _read(spark, sf_dir, table, *columns):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op7_decontamination(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    found = decontaminate.find_contamination(docs, _read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), decontaminate.items_digest(F.col("hit_items")).alias("items_sha256"), "contaminated"
    )


def op9_line_dedup(spark, sf_dir):
    out = line_dedup.drop_repeated_lines(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_suffix_array_dedup(spark, sf_dir):
    out = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


PII_KEY = "kvlake-demo-key"  # a deployment gives its own secret


def op3_pii_pseudonyms(spark, sf_dir):
    return pii.pseudonymise(_read(spark, sf_dir, "documents", "doc_id", "text"), PII_KEY)


def op4_chat_formatting(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    events = chat.messages_to_events(rows.unionByName(extra))
    return chat.digest(chat.format_turns(chat.reconstruct(events)))


def op5_quality_rules(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return quality.judge(docs, keep=["doc_id"]).select("doc_id", *quality.BASE, "kept", "distance2")


def op6_toxicity(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels", "doc_id", "toxic"))
    out = toxicity.score(docs, model)
    return out.select(
        "doc_id", (toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "toxic_spans"
    )


def op8_sentencepiece(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    out = sentencepiece.encode(docs, sentencepiece.read_model())
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return out.select("doc_id", "n_tokens", "n_byte_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "roundtrip", "parity")


def op10_kd_sharding(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    out = kd_sharding.shard(docs, ["doc_id", "lang", "source"], n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_pii_pseudonyms": op3_pii_pseudonyms,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_line_dedup": op9_line_dedup,
    "op10_kd_sharding": op10_kd_sharding,
}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM doc_words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (
  SELECT x, x FROM edges UNION SELECT e.y, reach.r FROM reach JOIN edges e ON e.x = reach.doc_id)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(m.r, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) m USING (doc_id)
""",
    "op4_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(role, '[\\<#:]', 'xx', 'g')) + length(regexp_replace(text, '[\\<#]', 'xx', 'g')) + 21) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
""",
    "op7_decontamination": r"""
WITH item_words AS (
  SELECT item_id, (regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, 13 AS n, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM item_words WHERE len(w) >= 13)
  UNION ALL
  SELECT item_id, len(w) AS n, list_aggregate(w, 'string_agg', ' ') AS win FROM item_words WHERE len(w) BETWEEN 1 AND 12),
lengths AS (SELECT DISTINCT n FROM windows),
doc_words AS (
  SELECT doc_id, (regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM documents),
places AS (
  SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words CROSS JOIN lengths WHERE len(w) >= n)),
found AS (SELECT p.doc_id, p.n, p.i, b.item_id FROM places p JOIN windows b ON p.n = b.n AND p.win = b.win),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op9_line_dedup": r"""
WITH cut AS (
  SELECT doc_id, i, l[i] AS line
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM cut),
firsts AS (SELECT k, min(doc_id) AS f FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT q.doc_id, q.i, q.line, f.f IS NOT NULL AND q.doc_id <> f.f AS gone FROM keyed q LEFT JOIN firsts f ON q.k = f.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
}
