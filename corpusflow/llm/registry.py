"""The queries of this package by name, and their SQL where SQL can say it."""

from __future__ import annotations

from . import alignment, bpe, chat_windows, fim, hmm_lm, langid, ngram_join, packing, quality, sharding, suffix_dedup, topk, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_exact_top_k": topk.op2_exact_top_k,
    "op3_hmm_lm": hmm_lm.op3_hmm_lm,
    "op4_sharding": sharding.op4_sharding,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_language_id": langid.op6_language_id,
    "op7_packing": packing.op7_packing,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_chat_formatting": chat_windows.op12_chat_formatting,
    "op13_cross_tokenizer_alignment": alignment.op13_cross_tokenizer_alignment,
}
ORACLE_SQL = {
    "op1_quality_rules": quality.SQL,
    "op2_exact_top_k": topk.SQL,
    "op11_fill_in_middle": fim.SQL,
    "op12_chat_formatting": chat_windows.SQL,
}
