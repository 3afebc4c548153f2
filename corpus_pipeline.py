"""A corpus pipeline: toxic documents go, then exact and near copies, then leaked benchmark items; sources are mixed last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqsift.llm.decontam import drop_contaminated
from seqsift.llm.exact import drop_exact_duplicates
from seqsift.llm.mixing import mix_sources
from seqsift.llm.near import drop_near_duplicates
from seqsift.llm.storage import Workspace
from seqsift.llm.toxicity import drop_toxic, toxicity_model


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.7 or more, each by its own whole text; null and empty texts score as texts without words."""
    return drop_toxic(docs, toxicity_model(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of equal texts, null ids last; null texts are empty ones, of repeated rows one stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group whose sets of five-word shingles link at a similarity of 0.8 or more; texts without words, and rows without an id, stay."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, those without an id too; without items all stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents so that sources weigh as the square root of their size, in a global random order; a null source is one of its own."""
    return mix_sources(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mixing", source_mixing)]

#: Learned models and retrieval are beyond SQL; tests hold the stages against brute force and planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again. Any stage passes an empty table on."""
    work, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.table(docs)
    return docs
