"""The corpus pipeline: toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Edge cases: null and empty texts are scored as empty ones, are equal texts for the
near-duplicate stage (the smallest doc_id of them stays), hold no personal data and
pack as one end token; rows without a doc_id are no one's duplicates and all stay; of
rows that share a doc_id the near-duplicate stage keeps one; very long texts go through
every stage whole; further columns, whatever their names, come through all stages but
the last; empty tables give no rows, and without labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchwell.llm import near_dup, packing, pii, toxicity
from watchwell.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores under 0.5; it learns from all labels."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("score") < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each class of near duplicates."""
    return near_dup.representatives(docs).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    masked = pii.redact(docs, pii.train(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every document."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_batches),
]

#: Trained classifiers and sketches can't be said in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
