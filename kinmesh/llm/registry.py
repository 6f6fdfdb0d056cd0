"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinmesh.llm import classifier, decontam, licenses, mixing, neardup, negatives, quality, sharding, substring, tokens, trie, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1,
        "op2_token_counts": tokens.op2,
        "op3_license_scan": licenses.op3,
        "op4_decontamination": decontam.op4,
        "op5_quality_rules": quality.op5,
        "op6_warc": warc.op6,
        "op7_token_binary": tokens.op7,
        "op8_mixing": mixing.op8,
        "op9_near_dedup": neardup.op9,
        "op10_substring_dedup": substring.op10,
        "op11_conversation_trie": trie.op11,
        "op12_hard_negatives": negatives.op12,
        "op13_quality_classifier": classifier.op13,
    }


def oracle_sql() -> dict[str, str]:
    """Of 2, 7 (a tokeniser's result), 9 (components of a similarity join) and 13 (a trained model) there is no SQL; tests hold them against brute force."""
    return {
        "op1_sharding": sharding.oracle(),
        "op3_license_scan": licenses.oracle(),
        "op4_decontamination": decontam.oracle(),
        "op5_quality_rules": quality.oracle(),
        "op6_warc": warc.oracle(),
        "op8_mixing": mixing.oracle(),
        "op10_substring_dedup": substring.oracle(),
        "op11_conversation_trie": trie.oracle(),
        "op12_hard_negatives": negatives.oracle(),
    }
