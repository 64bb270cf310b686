"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from kindred.llm import centroids, decontaminate, filter_audit, fingerprints, html_extract, mixing, near_dedup, packing, quality, secret_scan, substring, suffix, token_output


def queries() -> dict:
    return {
        "op1_token_output": token_output.op1_token_output,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_source_mixing": mixing.op3_source_mixing,
        "op4_secret_scans": secret_scan.op4_secret_scans,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_document_fingerprints": fingerprints.op6_document_fingerprints,
        "op7_substring_dedup": substring.op7_substring_dedup,
        "op8_html_extraction": html_extract.op8_html_extraction,
        "op9_simhash_near_dedup": near_dedup.op9_simhash_near_dedup,
        "op10_suffix_array_dedup": suffix.op10_suffix_array_dedup,
        "op11_benchmark_decontamination": decontaminate.op11_benchmark_decontamination,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_centroid_clustering": centroids.op13_centroid_clustering,
    }


def oracle_sql() -> dict:
    return {"op7_substring_dedup": substring.ORACLE_SQL, "op10_suffix_array_dedup": suffix.ORACLE_SQL, "op11_benchmark_decontamination": decontaminate.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL, "op13_centroid_clustering": centroids.ORACLE_SQL}
