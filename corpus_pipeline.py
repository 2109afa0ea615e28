"""The corpus pipeline: quality, near duplicates, benchmark passages, personal data, mixture.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is
written and read again before the next. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontam, mixing, neardup, pii, quality
from quillgraph.llm.tables import read, stored


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the weakly supervised rules accept."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near duplicates, the one of least doc_id."""
    return neardup.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of which benchmark passages cover less than a twentieth."""
    return decontam.clean(docs, read(spark, folder, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with personal data masked in the text; n_chars follows the text."""
    masked = docs.withColumn("text", pii.masked("text"))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def source_mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents sampled to the target shares of sources, languages and topics."""
    return mixing.sampled(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("source_mixture", source_mixture),
]

#: SQL can express neither the sketches nor the alignment; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
