"""Corpus pipeline: five stages over the documents table, each on what the one before kept.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. SQL cannot express the classifier, the fingerprints or the encoding, so there is no ORACLE_SQL;
the pipeline is tested against plain versions of its stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import exact_dedup, mixing, piece_codec, quality_classifier, simhash
from tidemark.llm.common import staged
from tidemark.llm.queries import piece_model

ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labels, finds good (neither toxic nor poor) more likely than not."""
    ratings = quality_classifier.grades(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.accepted(docs, quality_classifier.train(docs, ratings), wanted=2)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text up to white space the one with the smallest id."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar SimHash fingerprints (five-word shingles, similarity 0.8) the one with the smallest id."""
    return simhash.without_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document taken for two epochs comes twice."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with begin and end ids."""
    return piece_codec.encoded(docs, piece_model()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("sentencepiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; work tables between them are in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else staged(out, f"pipeline-{k}")
    return docs
