"""A training corpus from raw documents: four filters, then packing into sequences.

Each stage works on all that the one before it kept, which it reads from a Parquet table in the shared folder. Whole
texts count, however long; all but the last stage keep all columns, whatever their names, and go by rows: ids may be null
or repeat. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, near_join, packing, quality_model, quality_rules
from quarry.llm.common import spool


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels, scores 0.5 or more; null and empty texts by their statistics,
    repeated rows alike.
    """
    return quality_model.accepted(docs, quality_model.fit(docs, labels_of(spark, sf_dir)))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and the likelihood ratio, both taken over what is left of the corpus. Null, empty
    and very short texts fail; equal texts are judged alike.
    """
    return docs.where(quality_rules.fit(docs, labels_of(spark, sf_dir)).keeps(F.col("text")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the smallest id, null ids last; of repeated rows one. Null
    equals empty.
    """
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles the one with the smallest id, null ids
    last; of repeated rows one. Texts without words are linked with nothing and stay.
    """
    return near_join.representatives(docs, width=5, num=80, den=100)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens; null and empty texts are pieces of one token,
    repeated rows are packed each.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules_stage),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("best-fit packing", sequences),
]

#: Learned models and tokenizers can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
