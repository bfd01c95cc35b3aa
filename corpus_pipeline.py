"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing. Each stage reads what the last wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factgraph.llm import common, decontaminate, line_dedup, mixing, quality_rules, simhash_bk


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filtered(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat across documents."""
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each component of near-duplicates; documents without an id stay too."""
    return simhash_bk.representatives(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix to target domain weights takes, with their rates and copies.

    The rules before have taken poor text out, so all tokens are to come from the good domain, as many as there are."""
    return mixing.mixture(docs, common.table(spark, sf_dir, "labels"), {"good": 1.0, "poor": 0.0, "toxic": 0.0}, 1.0)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontaminate", benchmark_free),
    ("mixing", mix),
]

#: SimHash fingerprints and gradient steps have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result is written to the shared folder and read by the next stage."""
    docs = common.table(spark, sf_dir, "documents")
    base = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
