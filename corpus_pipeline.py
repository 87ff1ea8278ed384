"""The corpus pipeline: quality, exact dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last adds the topic,
the tokens, the sampling probability and the weight. Rows with one doc_id, null among them, share its fate in the two dedup stages;
quality and decontamination judge each by its text; mixing draws by doc_id, or by the text where there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from tessera.llm._runtime import shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _chosen(docs: DataFrame, groups: DataFrame) -> DataFrame:
    kept = groups.where("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _chosen(docs, exact_dedup.exact_groups(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 0.8 or more of the 5-word shingles in common."""
    return _chosen(docs, near_dedup.near_groups(docs, percent=80))


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the rest at the target weights."""
    return mixing.mix(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontaminate", clean_stage), ("mix", mix_stage)]

#: The quality model and the tiling cannot be put in SQL; tests/llm/test_pipeline.py holds each stage against brute force on all that the one before kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
