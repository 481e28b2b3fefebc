"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from docquarry.llm import chat, decontam, licenses, lm, mixing, ngram_join, pii, quality, rules, token_counts

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_ngram_join": ngram_join.query,
    "op3_license_scans": licenses.query,
    "op4_decontamination": decontam.query,
    "op5_mixing": mixing.query,
    "op6_pii": pii.query,
    "op7_lm_scoring": lm.query,
    "op8_chat_formatting": chat.query,
    "op9_quality_rules": rules.query,
    "op10_token_counts": token_counts.query,
    "quality_rules_ablation": rules.ablation_query,
}

SQL: dict[str, str] = {
    "op2_ngram_join": ngram_join.SQL,
    "op3_license_scans": licenses.SQL,
    "op5_mixing": mixing.SQL,
    "op8_chat_formatting": chat.SQL,
    "op9_quality_rules": rules.SQL,
    "quality_rules_ablation": rules.ABLATION_SQL,
}
