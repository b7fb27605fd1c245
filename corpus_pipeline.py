"""The corpus pipeline: documents -> toxicity, exact dedup, near dedup, decontamination, mixture.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame that is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticeboard.llm import decontamination, exact_dedup, jaccard_join, mixing, toxicity
from noticeboard.llm.common import table, unused
from noticeboard.llm.registry import MIX_WEIGHTS

#: from this score on a document counts as toxic
REJECT = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts stay."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    name = unused("_toxic", docs)
    return toxicity.score(docs, model, column=name).where(F.col(name) < REJECT).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text the one with the largest doc_id stays."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link, directly or through others, the one with the smallest doc_id stays (five words, 0.8)."""
    return jaccard_join.representatives(docs, ngram=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture."""
    return mixing.mix(docs, MIX_WEIGHTS)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: a trained model decides in the first stage, which SQL cannot express; tests/llm compares the other stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = exact_dedup.shared_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
