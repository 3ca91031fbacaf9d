"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from watchwell.llm import fingerprints, lm_score, near_dup, packing, pieces, pii, quality, runs, token_store, topk, toxicity, turn_trie, urls

_MODULES = (fingerprints, lm_score, near_dup, packing, pieces, pii, quality, runs, token_store, topk, toxicity, turn_trie, urls)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
