"""The registered queries of this subpackage and their SQL forms."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import lexical, link_trust, merkle
from seqloom.llm.common import fold, table


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings of one label, with links, component and representative."""
    from seqloom.llm.near_vectors import links

    return links(table(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces of at most 2048 tokens, packed into sequences."""
    from seqloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose word 3-grams have a Jaccard similarity of 0.9 or more."""
    from seqloom.llm.shingle_join import JoinConfig, links

    return links(table(spark, sf_dir, "documents"), JoinConfig(words=3, percent=90))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by segmentation-marginalised piece unigrams."""
    from seqloom.llm.language import identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fold("doc_id", 4, 2), public_tokenizers.path("piece_bpe_32k.model"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document in the bigram model."""
    from seqloom.llm.kneser_ney import score

    return score(table(spark, sf_dir, "documents"), fold("doc_id", 7, 2))


def op6_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page by rules and link-graph propagation."""
    from seqloom.llm.link_trust import judge

    return judge(table(spark, sf_dir, "pages"))


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of the labellers' votes, score and verdict of every document."""
    from seqloom.llm.weak_quality import report

    return report(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the streaming transducer."""
    from seqloom.llm.byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the risk-controlled quality rules for every document."""
    from seqloom.llm.risk_rules import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by rank-synchronous merging."""
    from seqloom.llm.piece_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and verification after tampering of every document in the Merkle manifest."""
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item by Block-Max MaxScore."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by fixed patterns and by the guess cost of values in credential contexts."""
    from seqloom.llm.secret_scan import report

    return report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {
    "op1_near_vectors": op1_near_vectors,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_shingle_join": op3_shingle_join,
    "op4_language": op4_language,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_link_trust": op6_link_trust,
    "op7_weak_quality": op7_weak_quality,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_risk_rules": op9_risk_rules,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lexical_search": op12_lexical_search,
    "op13_secret_scan": op13_secret_scan,
}
ORACLES: dict[str, str] = {
    "op6_link_trust": link_trust.oracle_sql(),
    "op11_merkle_manifest": merkle.oracle_sql(),
    "op12_lexical_search": lexical.oracle_sql(),
}
