"""Queries of the training-data operators; those that SQL can express have an entry in ORACLE_SQL."""

from __future__ import annotations

from . import chat_format, collocations, decontamination, license_scan, lm_scoring, packing, quality_classifier, quality_rules, sharding, simhash_dedup, source_audit, substring_dedup, url_filter

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_suffix_array_dedup": substring_dedup.op7_suffix_array_dedup,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_simhash_dedup": simhash_dedup.op9_simhash_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_license_scan": license_scan.op11_license_scan,
    "op12_source_divergence": source_audit.op12_source_divergence,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": quality_rules.SQL, "op5_chat_format": chat_format.SQL, "op12_source_divergence": source_audit.SQL, "op13_collocations": collocations.SQL}
