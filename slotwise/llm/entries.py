"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_pairs, embedding_dedup, html_text, license_scan, line_dedup, merkle, mixing, ngram_jaccard, packing, prefix_trie, quality_classifier, quality_rules, substring_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_ngram_jaccard": ngram_jaccard.op2_ngram_jaccard,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_quality_classifier": quality_classifier.op4_quality_classifier,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_html_extraction": html_text.op6_html_extraction,
        "op7_mixing": mixing.op7_mixing,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_byte_pairs": byte_pairs.op12_byte_pairs,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
        "quality_rule_signals": quality_rules.quality_rule_signals,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op2_ngram_jaccard": ngram_jaccard.OP2_SQL,
        "op3_license_scan": license_scan.oracle(),
        "op10_embedding_dedup": embedding_dedup.OP10_SQL,
        "op11_prefix_trie": prefix_trie.oracle(),
        "op13_merkle_manifest": merkle.oracle(),
        "quality_rule_signals": quality_rules.SIGNALS_SQL,
    }
