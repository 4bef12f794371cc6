"""The queries of this folder by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, kneser_ney, language_id, line_dedup, mixing, ngram_join, pii, quality_rules, spelling, topk_search, url_rules, vector_codes


def queries() -> dict:
    return {
        "op1_chat_format": chat.query,
        "op2_mix_sources": mixing.query,
        "op3_decontaminate": decontaminate.query,
        "op4_language_id": language_id.query,
        "op5_quality_rules": quality_rules.query,
        "op6_ngram_join": ngram_join.query,
        "op7_kneser_ney": kneser_ney.query,
        "op8_pii": pii.query,
        "op9_line_dedup": line_dedup.query,
        "op10_url_rules": url_rules.query,
        "op11_vector_codes": vector_codes.query,
        "op12_spelling_variants": spelling.query,
        "op13_topk_search": topk_search.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat.SQL,
        "op3_decontaminate": decontaminate.SQL,
        "op10_url_rules": url_rules.SQL,
        "op11_vector_codes": vector_codes.SQL,
        "op12_spelling_variants": spelling.SQL,
        "op13_topk_search": topk_search.SQL,
    }
