"""Queries and oracle SQL of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evigraph.llm import chat, decontaminate, fingerprints, mixing, secrets, sharding, simhash, substring_dedup, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_sharding": sharding.query,
    "op3_fingerprints": fingerprints.query,
    "op4_decontaminate": decontaminate.query,
    "op5_secrets": secrets.query,
    "op6_toxicity": toxicity.query,
    "op7_mixing": mixing.query,
    "op8_url_filter": url_filter.query,
    "op9_simhash": simhash.query,
    "op10_chat": chat.query,
}
ORACLES: dict[str, str] = {
    "op2_sharding": sharding.ORACLE_SQL,
    "op5_secrets": secrets.ORACLE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
}
