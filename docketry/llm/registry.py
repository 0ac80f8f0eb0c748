"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import embedding_dedup, kneser_ney, mixing, ngram_join, packing, quality_rules, secret_scan, substring_dedup, token_counts, token_files

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1,
    "op2_token_counts": token_counts.op2,
    "op3_token_files": token_files.op3,
    "op4_packing": packing.op4,
    "op5_quality_rules": quality_rules.op5,
    "op6_ngram_join": ngram_join.op6,
    "op7_mixing": mixing.op7,
    "op8_secret_scan": secret_scan.op8,
    "op9_substring_dedup": substring_dedup.op9,
    "op10_quality_classifier": kneser_ney.op10,
}

ORACLE_SQL = {"op1_embedding_dedup": embedding_dedup.OP1_SQL, "op5_quality_rules": quality_rules.OP5_SQL, "op6_ngram_join": ngram_join.OP6_SQL, "op8_secret_scan": secret_scan.OP8_SQL, "op9_substring_dedup": substring_dedup.OP9_SQL}
