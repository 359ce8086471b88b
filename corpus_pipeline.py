"""From raw documents to packed training sequences, each stage on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colscope.llm import jaccard, packing, repetition, secrets, tiling
from colscope.llm.common import written
from colscope.llm.queries import tokenizer_path
from colscope.session import shared_folder


# Near copies share 80 of 100 word 5-grams or more; ``op8_jaccard`` has a contract of its own.
NEAR_COPIES = jaccard.Jaccard(words=5, num=80, den=100)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat themselves too much, or are too short, go."""
    return repetition.drop_repetitive(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    return jaccard.drop_near_duplicates(docs, NEAR_COPIES)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more go."""
    return tiling.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text."""
    return secrets.mask_secrets(docs, shared_folder(spark, "ledger"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path(), with_ids=False))


STAGES = [
    ("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination),
    ("secret scans", secret_scans), ("best-fit packing", best_fit_packing),
]
# Masks, tiles and bins have no equal in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
