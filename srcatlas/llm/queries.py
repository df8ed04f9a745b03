"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, exact_dedup, jaccard, lexical, mixing, quality, sharding, simhash, substring_dedup, token_counts, toxicity, url_filter, whitening

QUERIES = {f.__name__: f for f in (
    decontamination.op1_decontamination, toxicity.op2_toxicity, token_counts.op3_token_counts, simhash.op4_simhash_near_dedup,
    quality.op5_quality_classifier, url_filter.op6_url_filter, exact_dedup.op7_exact_dedup,
    substring_dedup.op8_substring_dedup, mixing.op9_mixing, sharding.op10_sharding, jaccard.op11_jaccard_join,
    whitening.op12_embedding_whitening, lexical.op13_lexical_search,
)}

SQL = {
    "op1_decontamination": decontamination.OP1_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL, "op9_mixing": mixing.OP9_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL, "op11_jaccard_join": jaccard.OP11_SQL, "op13_lexical_search": lexical.OP13_SQL,
}
