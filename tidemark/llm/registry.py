"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import op1_substring, op2_bpe, op3_jaccard, op4_suffix, op5_quality, op6_chat, op7_topk, op8_toxicity, op9_urls, op10_decontaminate, op11_negatives, op12_divergence, op13_pii

QUERIES = {
    "op1_substring_dedup": op1_substring.op1_substring_dedup,
    "op2_bpe": op2_bpe.op2_bpe,
    "op3_ngram_jaccard_join": op3_jaccard.op3_ngram_jaccard_join,
    "op4_suffix_dedup": op4_suffix.op4_suffix_dedup,
    "op5_quality": op5_quality.op5_quality,
    "op6_chat_format": op6_chat.op6_chat_format,
    "op7_exact_topk": op7_topk.op7_exact_topk,
    "op8_toxicity": op8_toxicity.op8_toxicity,
    "op9_url_filters": op9_urls.op9_url_filters,
    "op10_decontaminate": op10_decontaminate.op10_decontaminate,
    "op11_hard_negatives": op11_negatives.op11_hard_negatives,
    "op12_source_divergence": op12_divergence.op12_source_divergence,
    "op13_pii": op13_pii.op13_pii,
}

ORACLE_SQL = {
    "op1_substring_dedup": op1_substring.ORACLE_SQL,
    "op3_ngram_jaccard_join": op3_jaccard.ORACLE_SQL,
    "op6_chat_format": op6_chat.ORACLE_SQL,
    "op7_exact_topk": op7_topk.ORACLE_SQL,
    "op9_url_filters": op9_urls.ORACLE_SQL,
    "op11_hard_negatives": op11_negatives.ORACLE_SQL,
    "op12_source_divergence": op12_divergence.ORACLE_SQL,
    "op13_pii": op13_pii.ORACLE_SQL,
}
