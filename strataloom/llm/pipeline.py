"""The corpus pipeline: documents in, packed training pieces out, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hyperminhash, packing, paragraphs, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or whose posterior quality is low go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays.

    Rows without words or without an id stay. Of rows that are equal in all columns one stays; different texts of one
    doc_id, which the operator takes for one node, all stay where that doc_id does.
    """
    found = hyperminhash.near_duplicates(docs.select(F.col("doc_id").alias("id"), "text"), 5, 80, 100)
    gone = common.durable(found.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct())
    few = F.broadcast(gone) if gone.count() <= common.BROADCAST_IDS else gone
    kept = docs.join(few, "doc_id", "left_anti").select(*docs.columns)
    again = common.durable(found.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("doc_id")))
    if again.isEmpty():
        return kept
    few = F.broadcast(again) if again.count() <= common.BROADCAST_IDS else again
    return kept.join(few, "doc_id", "left_anti").unionByName(kept.join(few, "doc_id", "left_semi").distinct()).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs that repeat an earlier one go."""
    return paragraphs.drop_repeats(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base secrets and those that look live are replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("minhash near-dedup", near_duplicates), ("substring dedup", substring_dedup), ("secret scans", secret_scans), ("packing", pack)]

#: Expectation-maximisation, similarity over shingle hashes, components and tokens aren't expressed in SQL; tests/llm
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, docs = common.mark(), common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.durable(docs)
            common.drop_scratch(start, keep=(docs,))
    return docs
