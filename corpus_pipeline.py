"""The corpus pipeline: quality rules, quality classifier, near duplicates, packing.

Every stage takes ``(spark, docs, sf_dir)``; its result is written to the shared
folder and read again as the documents of the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no risk-controlled rule rejects."""
    from seqloom.llm.risk_rules import kept

    return kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not reject."""
    from seqloom.llm.weak_quality import kept

    return kept(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word 5-grams with a Jaccard similarity of 0.8 or more."""
    from seqloom.llm.shingle_join import JoinConfig, representatives

    return representatives(docs, JoinConfig(words=5, percent=80))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in sequences of 2048 tokens."""
    from seqloom.llm.packing import pack

    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", ngram_jaccard),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.common import Scratch

    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = scratch.write(stage(spark, docs, sf_dir), name)
    return docs


#: The stages hold trained models and a tokenizer, which SQL can't express.
ORACLE_SQL = None
