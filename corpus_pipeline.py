"""From raw documents to packed training sequences, as five stages.

Each stage gets all that its predecessor kept, and all but the last return the
columns of ``documents``:

1. language: documents without a letter go;
2. exact: of equal texts (A-Z folded) the largest doc_id stays;
3. near: of each group of near duplicates (five-word shingles, similarity 0.75) the smallest doc_id stays;
4. benchmark: documents of which at least a twentieth lies in benchmark windows go;
5. pack: what is left is packed into sequences of 2048 tokens, whose ids are written.

ORACLE_SQL is None: the mixture inference and the retrieval order have no SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from depotlens.llm import contamination, exact, jaccard, language, packing
from depotlens.llm.common import scratch, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language_stage), ("exact", exact_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("pack", pack_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
