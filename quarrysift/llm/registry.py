"""Queries of the corpus operators, one for each, over whole tables."""

from __future__ import annotations

from . import chat, decontaminate, mixing, ngram_join, packing, quality, ranked, simhash, substring, tokens, toxicity, urls, variants


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_quality": quality.op2_quality,
        "op3_substring": substring.op3_substring,
        "op4_chat_format": chat.op4_chat_format,
        "op5_packing": packing.op5_packing,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_url_filter": urls.op8_url_filter,
        "op9_token_counts": tokens.op9_token_counts,
        "op10_mixing": mixing.op10_mixing,
        "op11_ranked_search": ranked.op11_ranked_search,
        "op12_variants": variants.op12_variants,
        "op13_ngram_join": ngram_join.op13_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_substring": substring.OP3_SQL, "op4_chat_format": chat.OP4_SQL, "op8_url_filter": urls.OP8_SQL, "op11_ranked_search": ranked.OP11_SQL, "op13_ngram_join": ngram_join.OP13_SQL}
