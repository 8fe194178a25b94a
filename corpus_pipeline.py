"""From raw documents to packed training sequences: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes what its predecessor kept and, but for the last, returns the columns of documents.
``run`` writes every stage's result as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash, mixing, packing, quality, secrets
from tidemark.llm.common import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates on word shingles: five words, similarity 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps; a null text is empty and goes, repeated rows are judged one by one,
    an empty table gives none."""
    rows = docs.select(*COLUMNS).select(F.struct("*").alias("row"), "text")
    kept = quality.POLICIES[quality.CURRENT].keeps(F.col("fail_bits"))
    # a condition on the row number, which is not deterministic, keeps the filter above the finished column;
    # pushed into the condition, the measurements would be computed many times
    judged = quality.ledger(rows).select("row", kept.alias("kept"), F.monotonically_increasing_id().alias("n"))
    return judged.where("kept AND n >= 0").select(*[F.col(f"row.{c}") for c in COLUMNS])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts, the one of the smallest (doc_id, hash of the text); of
    equal texts under one doc_id the smallest row. A doc_id on rows of different texts keeps a row of each
    group; rows without a doc_id or without words all stay. An empty table gives none; columns other than
    those of documents are left out."""
    docs = docs.select(*COLUMNS)
    key = ["doc_id", "text_key"]
    found = stage(minhash.text_groups(docs, SHINGLE_WORDS, SIMILARITY_PERCENT).where("component IS NOT NULL").select(*key, "component"), "pipeline-groups")
    first = found.groupBy("component").agg(F.min(F.struct(*key)).alias("first")).select("first.*")
    rows = found.groupBy(*key).agg(F.count("*").alias("n")).join(first.withColumn("stays", F.lit(True)), key, "left")
    rows = stage(rows.where("stays IS NULL OR n > 1").select(*key, F.coalesce("stays", F.lit(False)).alias("stays")), "pipeline-copies")
    keyed = docs.select("*", minhash.text_key())
    again = (keyed.join(rows.where("stays"), key, "left_semi").groupBy(*key)
             .agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")))
    return (keyed.join(rows.hint("merge"), key, "left_anti").select(*COLUMNS)  # rows grow with the documents
            .unionByName(again.select("doc_id", *[F.col(f"row.{c}") for c in COLUMNS[1:]])))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced in the text and n_chars counted anew; null texts stay as they are,
    an empty table gives none."""
    clean = secrets.redact_texts(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample whose tokens are raked to the target shares of source, language and topic; null sources and
    languages are a category like any other, an empty table gives none."""
    return mixing.sample(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences; a null text is empty, an empty table gives none."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mixing", mixing_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express decoding, raking or packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
