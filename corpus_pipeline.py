"""A corpus pipeline: five operators, one after the other, over the documents table.

All stages but the last return their input's columns, whatever others there are beside those that they read (doc_id, text,
source, n_chars), and an empty table for an empty one.  What each does with nulls, empty texts, ties and repeated rows is said
beside it; long texts are read whole by all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import blocks, decontam, mixing, ngram_join, pii, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of quality and toxicity accepts.

    Null texts and those without a word are rejected; repeated rows share their fate; a null doc_id doesn't matter; without
    usable labels all documents that have a word stay.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of lowest doc_id, of each group connected by near-duplicate pairs.

    Null and empty texts are near to nothing and stay; rows of a null doc_id stay; rows that repeat one doc_id share its fate.
    """
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Null and empty texts stay, and so does everything if the benchmark is empty; repeated rows share their fate.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced.

    Null and empty texts stay as they are; repeated rows are changed alike; n_chars follows the text.
    """
    return pii.redact(docs)


def mixing_schedule(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What to read at each slot of the training mix.

    Null and blank texts have nothing to read; a null source is the source ''; documents of equal shuffle order (null or repeated
    doc_ids) are ordered by doc_id, then number of tokens; repeated rows are read as often as they repeat.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing_schedule),
]

#: The first stage's model can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents, each to its predecessor's Parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = blocks.written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
