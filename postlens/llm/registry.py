"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe_chunks, conversation_trie, dataset_manifest, html_extraction, language_id, license_scan, merkle_fingerprints, ngram_join, quality_classifier, quality_rules, source_mixing, substring_dedup, token_counts

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_quality_rules": quality_rules.query,
    "op3_bpe_chunks": bpe_chunks.query,
    "op4_quality_classifier": quality_classifier.query,
    "op5_license_scan": license_scan.query,
    "op6_token_counts": token_counts.query,
    "op7_html_extraction": html_extraction.query,
    "op8_ngram_join": ngram_join.query,
    "op9_source_mixing": source_mixing.query,
    "op10_merkle_fingerprints": merkle_fingerprints.query,
    "op11_language_id": language_id.query,
    "op12_conversation_trie": conversation_trie.query,
    "op13_dataset_manifest": dataset_manifest.query,
}

ORACLE: dict[str, str] = {
    "op5_license_scan": license_scan.ORACLE_SQL,
    "op12_conversation_trie": conversation_trie.ORACLE_SQL,
    "op13_dataset_manifest": dataset_manifest.ORACLE_SQL,
}
