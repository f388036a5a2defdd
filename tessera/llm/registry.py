"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, jaccard_join, license_scan, lm_scoring, packing, pieces, quality_rules, sharding, suffix_dedup, token_files

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_sharding": sharding.op3_sharding,
    "op4_token_files": token_files.op4_token_files,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_license_scans": license_scan.op9_license_scans,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}

ORACLE_SQL = {
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op10_jaccard_join": jaccard_join.OP10_SQL,
}
