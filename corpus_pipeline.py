"""The training-data pipeline: filter by quality, join near duplicates, decontaminate, mask secrets, pack.

Each stage reads what its predecessor kept, written as Parquet, and works on all of it. All stages but the last return the
columns of ``documents``. A text that repeats, is null, empty or very long follows the rule of the stage's operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.llm.decontaminate import leaks
from webcorpus.llm.ngram_join import ngram_join
from webcorpus.llm.packing import pack
from webcorpus.llm.quality import fit, scored
from webcorpus.llm.queries import TOKENIZER, table
from webcorpus.llm.secret_scan import masked
from webcorpus.session import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least one half. Rows with an odd remainder stay out of the fit, as in the query."""
    labels = table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    weights = fit(docs, labels.where(~held_out))
    return scored(docs, weights).where("score >= 0.5").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest key. Documents without a key stay."""
    joined = ngram_join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(joined, "doc_id", "left_anti").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = written(leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets masked in their texts."""
    return masked(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    pieces = pack(docs, TOKENIZER)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", packing),
]
ORACLE_SQL = None  # a fitted classifier and a tokenizer can't be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
