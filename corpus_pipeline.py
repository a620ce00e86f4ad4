"""A corpus pipeline: quality rules, near duplicates, personal data, source
mixture, packing.  Every stage takes (spark, docs, sf_dir) and returns a
DataFrame; ``run`` writes each stage's rows to the shared folder, reads them
back for the next and deletes them once that one is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import mixing, near_copies, packing, pii_crf, repetition
from tremor.session import discard, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return repetition.filter_repetition(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words,
    Jaccard similarity 0.8 or more."""
    return near_copies.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans give way to marks; n_chars follows the text."""
    text = pii_crf.redact(F.col("text"), pii_crf.fit(docs))
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it."""
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixture", source_mixture),
    ("packed_sequences", packed_sequences),
]

#: The packing stage's token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(done)
    return STAGES[-1][1](spark, docs, sf_dir)
