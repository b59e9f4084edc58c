"""Queries and SQL of the operators, for registration."""

from __future__ import annotations

from arcwright.llm import decontaminate, exact_dedup, jaccard_join, langid, lm_score, packing, quality, sharding, token_counts, wavelet

_QUERIES = {
    "op1_language_id": langid,
    "op2_ngram_jaccard_join": jaccard_join,
    "op3_quality_classifier": quality,
    "op4_exact_dedup": exact_dedup,
    "op5_token_counts": token_counts,
    "op6_best_fit_packing": packing,
    "op7_lm_scoring": lm_score,
    "op8_decontaminate": decontaminate,
    "op9_token_output": wavelet,
    "op10_sharding": sharding,
}


def queries() -> dict:
    return {name: module.query for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _QUERIES.items() if module.SQL}
