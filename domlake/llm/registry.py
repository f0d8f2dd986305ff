"""Queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from domlake.llm import (byte_bpe, decontaminate, hnsw, jaccard_join, kneser_ney, language_id, license_scan, mixing, phrases, suffix_dedup,
                         toxicity, url_rules, whitening)

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op4_url_rules": url_rules.op4_url_rules,
    "op2_embedding_dedup": hnsw.op2_embedding_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_lm_scores": kneser_ney.op7_lm_scores,
    "op8_licenses": license_scan.op8_licenses,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_mix": mixing.op10_mix,
    "op11_whitening": whitening.op11_whitening,
    "op12_phrases": phrases.op12_phrases,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}
ORACLES = {
    "op4_url_rules": url_rules.ORACLE,
    "op10_mix": mixing.ORACLE,
    "op12_phrases": phrases.ORACLE,
}
