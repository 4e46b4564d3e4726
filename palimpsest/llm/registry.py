"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from palimpsest.llm import chat, decontaminate, jaccard, langid, mixing, pii, spandedup, sql, tokenstore, topk, toxicity

QUERIES = {
    "op1_chat_format": chat.query,
    "op2_pii": pii.query,
    "op3_token_ids": tokenstore.query,
    "op4_toxicity": toxicity.query,
    "op5_language_id": langid.query,
    "op6_ngram_jaccard": jaccard.query,
    "op7_sentence_spans": spandedup.query,
    "op8_decontaminate": decontaminate.query,
    "op9_top_k": topk.query,
    "op10_mix_sources": mixing.query,
}

ORACLES: dict[str, str] = {"op6_ngram_jaccard": sql.JACCARD, "op8_decontaminate": sql.DECONTAMINATE, "op9_top_k": topk.ORACLE_SQL}
