"""Registered queries of the llm subpackage and their SQL. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import docpairs, handwritten, mixture, quality, syntax, tokens
from weftgraph.session import cut
from weftgraph.sources.tables import live_entities, table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken(table(spark, d, "file_sources"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "file_sources"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "file_sources"), table(spark, d, "upstream_files"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.shares(table(spark, d, "file_sources"), table(spark, d, "upstream_files"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Function, signature, description and code of every documented function."""
    return docpairs.pairs(live_entities(table(spark, d, "code_functions")), live_entities(table(spark, d, "code_classes")), table(spark, d, "file_sources"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs(spark, d).select("repo_id", "function_id").distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a text in the mixture, with the slot of its block."""
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares_full(spark: SparkSession, d: str) -> DataFrame:
    """The report for a total of all tokens there are: small sources fall short, no large one is cut for their sake."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    return mixture.report(docs, targets, total=mixture.available(docs, targets))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """All statistics of every document with percentiles, robust z-scores and the number of tails."""
    stats = cut(quality.statistics(table(spark, d, "documents")))
    return quality.scored(stats, quality.quantiles(quality.sketches(stats)))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    stats = cut(quality.statistics(table(spark, d, "documents")))
    return quality.prose(stats).select("doc_id").distinct()


QUERIES: dict[str, Query] = {"p2_found": p2_found, "p2_rates": p2_rates, "p5_found": p5_found, "p5_shares": p5_shares, "p6_found": p6_found, "p6_pairs": p6_pairs, "p7_ids": p7_ids, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_shares_full": p8_shares_full, "p9_found": p9_found, "p9_statistics": p9_statistics}

ORACLE: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
