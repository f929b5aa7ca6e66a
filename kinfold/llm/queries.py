"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from . import additive_quantisation, chat, decontaminate, minhash, secrets, sentencepiece, suffix_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "op1_additive_quantisation": additive_quantisation.query,
    "op2_decontaminate": decontaminate.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_minhash": minhash.query,
    "op5_secrets": secrets.query,
    "op6_chat": chat.query,
    "op7_toxicity": toxicity.query,
    "op8_url_filter": url_filter.query,
    "op9_sentencepiece": sentencepiece.query,
    "op10_token_counts": token_counts.query,
}

ORACLE_SQL = {
    "op2_decontaminate": decontaminate.SQL,
    "op3_suffix_dedup": suffix_dedup.SQL,
    "op4_minhash": minhash.SQL,
    "op6_chat": chat.SQL,
    "op8_url_filter": url_filter.SQL,
}
