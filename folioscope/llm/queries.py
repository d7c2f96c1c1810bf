"""The registered queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from folioscope.llm import decontaminate, exact_dedup, language, language_model, mixing, near_dup, pii, repeats, sharding, toxicity

QUERIES = {
    "op1_language_id": language.query,
    "op2_mixing": mixing.query,
    "op3_sharding": sharding.query,
    "op4_ngram_jaccard": near_dup.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_lm_scoring": language_model.query,
    "op7_decontamination": decontaminate.query,
    "op8_pii": pii.query,
    "op9_suffix_dedup": repeats.query,
    "op10_toxicity": toxicity.query,
}

#: Operators without SQL are tested against brute force, exact round trips or held-out rows in tests/llm.
ORACLE = {
    "op4_ngram_jaccard": near_dup.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op7_decontamination": decontaminate.SQL,
    "op9_suffix_dedup": repeats.SQL,
}
