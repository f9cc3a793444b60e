"""Registered queries of the corpus operators and their SQL."""

from mdmill.llm import (
    bpe,
    exact_dedup,
    fingerprints,
    language,
    mixing,
    ngram_join,
    periods,
    resampling,
    sharding,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_merkle_fingerprints": fingerprints.op1_merkle_fingerprints,
    "op2_kd_sharding": sharding.op2_kd_sharding,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_ngram_jaccard": ngram_join.op4_ngram_jaccard,
    "op5_poisson_mix": mixing.op5_poisson_mix,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_language_id": language.op9_language_id,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_simhash_anchors": simhash.op12_simhash_anchors,
    "op13_periodic_runs": periods.op13_periodic_runs,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_poisson_mix": mixing.OP5_SQL,
    "op11_importance_resampling": resampling.OP11_SQL,
}
