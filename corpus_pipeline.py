"""Corpus pipeline: toxicity, exact dedup, near dedup, secret masking, packing; each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eligrid.llm import stages
from eligrid.llm.common import load, stored

STAGES = [
    ("toxicity", stages.toxicity),
    ("exact_dedup", stages.exact_dedup),
    ("ngram_jaccard", stages.ngram_jaccard),
    ("secrets", stages.secrets),
    ("packing", stages.packing),
]

# Scores, shingles and token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
