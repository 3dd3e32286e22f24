"""From documents to packed training sequences: toxicity, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; ``run`` writes each stage's
result to the shared folder as Parquet and reads it again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm import chunks, mixing, nearcopies, packing, toxicity
from scoreloom.llm.shared import shared_folder


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model, learnt from the labels, rejects."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id: groups by SimHash first, then near
    copies with other bits (five-word shingles, similarity 0.8)."""
    return nearcopies.keep_one_of_all(docs)


def first_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id has."""
    return chunks.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's share along the curriculum: some documents go, some come twice."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents' pieces in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", civil),
    ("near_dedup", one_of_each),
    ("substring_dedup", first_passages),
    ("mixing", mixed),
    ("packing", packed),
]

#: No SQL: a trained model, a rolling hash and best-fit rounds are among the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
