"""Queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from entitylens.llm import ann_permutation, chat_format, hard_negatives, license_scan, merkle, mixing, ngram_join, packing, quality_rules, secret_scan, sharding, suffix_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.op1,
    "op2_token_counts": token_counts.op2,
    "op3_license_scan": license_scan.op3,
    "op4_quality_rules": quality_rules.op4,
    "op5_ann_permutation": ann_permutation.op5,
    "op6_suffix_dedup": suffix_dedup.op6,
    "op7_packing": packing.op7,
    "op8_mixing": mixing.op8,
    "op9_secret_scan": secret_scan.op9,
    "op10_ngram_join": ngram_join.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_hard_negatives": hard_negatives.op12,
    "op13_chat_format": chat_format.op13,
}

ORACLES: dict[str, str] = {
    "op1_sharding": sharding.OP1_SQL,
    "op3_license_scan": license_scan.OP3_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_secret_scan": secret_scan.OP9_SQL,
    "op10_ngram_join": ngram_join.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_chat_format": chat_format.OP13_SQL,
}
