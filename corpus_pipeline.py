"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), with docs the rows that its predecessor
kept, and returns a DataFrame; ``run`` writes each as Parquet in the shared
folder and reads it again.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm import decontaminate, line_dedup, ngram_join, quality, sentencepiece
from kvlake.llm.common import store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the outlier test rejects go; a null text is
    among them.  Null language or source is a value of its own.  Rows of one doc_id
    are judged one by one."""
    return quality.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the document of the smallest doc_id only; texts and
    n_chars change.  Rows of one doc_id are one document; a null doc_id takes no part."""
    out = line_dedup.drop_repeated_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id, with all its
    rows.  Null doc_ids, and texts without words, are in no group and stay."""
    return ngram_join.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others, benchmark spans are cut.  Rows
    are judged one by one; a null or empty text stays."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = decontaminate.remove_contamination(docs.select(*COLUMNS), benchmark)
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether decoding them gives the text back; a null
    or empty text has none.  Rows of equal or null doc_id stay apart."""
    out = sentencepiece.encode(docs.select("doc_id", "text"), sentencepiece.read_model(), decode=False)
    return out.select("doc_id", "ids", "n_tokens", "n_byte_tokens", "roundtrip", "parity")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", tokens),
]

#: The robust outlier estimate and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
