"""The registered queries of the subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, embed_dup, fim, importance, license_scan, lm_score, near_dup, quality, secret_scan, sentence_pieces, sharding, tool_calls

QUERIES = {
    "op1_secret_forest": secret_scan.query,
    "op2_stupid_backoff": lm_score.query,
    "op3_spaced_seeds": decontaminate.query,
    "op4_vector_bin_packing": sharding.query,
    "op5_cross_polytope": embed_dup.query,
    "op6_license_scan": license_scan.query,
    "op7_byte_bpe": bpe.query,
    "op8_tool_call_linking": tool_calls.query,
    "op9_minhash_near_dedup": near_dup.query,
    "op10_quality_classifier": quality.query,
    "op11_importance_resampling": importance.query,
    "op12_sentence_pieces": sentence_pieces.query,
    "op13_fill_in_middle": fim.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_stupid_backoff": lm_score.SQL,
    "op5_cross_polytope": embed_dup.SQL,
    "op9_minhash_near_dedup": near_dup.SQL,
    "op11_importance_resampling": importance.SQL,
}
