"""Queries of the text operators, and the SQL that checks them."""

from __future__ import annotations

from . import bpe, centroids, decontaminate, exact_dedup, jaccard, language_model, lattice, line_dedup, periodic_runs, quality, sharding, substring_dedup, toxicity


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.query,
        "op2_bpe": bpe.query,
        "op3_exact_dedup": exact_dedup.query,
        "op4_lm_scoring": language_model.query,
        "op5_decontamination": decontaminate.query,
        "op6_jaccard_join": jaccard.query,
        "op7_sharding": sharding.query,
        "op8_quality": quality.query,
        "op9_substring_dedup": substring_dedup.query,
        "op10_toxicity": toxicity.query,
        "op11_periodic_runs": periodic_runs.query,
        "op12_embedding_near_dedup": lattice.query,
        "op13_centroid_clustering": centroids.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.SQL,
        "op3_exact_dedup": exact_dedup.SQL,
        "op5_decontamination": decontaminate.SQL,
        "op6_jaccard_join": jaccard.SQL,
        "op9_substring_dedup": substring_dedup.SQL,
        "op12_embedding_near_dedup": lattice.SQL,
        "op13_centroid_clustering": centroids.SQL,
    }
