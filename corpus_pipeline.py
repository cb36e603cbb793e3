"""A training corpus from documents: filter, deduplicate, mix, pack.

Each stage takes what its predecessor kept, written as Parquet to the shared
folder and read again. All stages but the last return the columns of
``documents``; the last returns the packed pieces.

Defined cases, for every stage: a null text is an empty one, and so is judged,
compared, mixed and packed; null ids, sources and languages are values like
others; rows repeated are rows of their own until a stage merges them; empty
and very long texts are handled whole; an empty table gives an empty result;
columns beyond doc_id, text and source, whatever their names, are handed
through by the first four stages and left by the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import exact_dedup, mixing, near_dup, packing, quality
from siltstone.llm._shared import materialise, spread


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, does not reject; all of them where no label is known."""
    return quality.good_documents(spread(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the least id, null ids last; of equal rows, one."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts: that with the least id, null ids last; texts without words are one class."""
    return near_dup.distinct_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' target weights take them; those without words are in no mixture."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids; an empty text is its end id."""
    return packing.pack(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("packing", packed),
]

#: No stage sequence of models and similarity classes has a SQL equivalent; tests compare brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
