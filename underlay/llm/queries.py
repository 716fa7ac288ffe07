"""The operators' queries and their SQL."""

from __future__ import annotations

from . import ann, bpe, decontamination, filter_audit, jaccard_join, license_scan, line_dedup, lm_scoring, pii, quality_rules, sharding, target_resampling, toxicity

QUERIES = {
    "op1_lm_scoring": lm_scoring.query,
    "op2_toxicity": toxicity.query,
    "op3_license_scan": license_scan.query,
    "op4_jaccard_join": jaccard_join.query,
    "op5_ann": ann.query,
    "op6_pii": pii.query,
    "op7_bpe": bpe.query,
    "op8_decontamination": decontamination.query,
    "op9_sharding": sharding.query,
    "op10_line_dedup": line_dedup.query,
    "op11_filter_audit": filter_audit.query,
    "op12_quality_rules": quality_rules.query,
    "op13_target_resampling": target_resampling.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": license_scan.ORACLE,
    "op8_decontamination": decontamination.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_quality_rules": quality_rules.ORACLE,
    "op13_target_resampling": target_resampling.ORACLE,
}
