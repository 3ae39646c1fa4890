"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, divergence, exact_dedup, filter_audit, html_extraction, licenses, media, minhash_dedup, packing, quality, substring_dedup, toxicity, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_html_extraction": html_extraction.op4_html_extraction,
    "op5_bpe": bpe.op5_bpe,
    "op6_warc_derivatives": warc.op6_warc_derivatives,
    "op7_media_columns": media.op7_media_columns,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_minhash_near_dedup": minhash_dedup.op10_minhash_near_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_quality": quality.op13_quality,
}

ORACLE_SQL = {"op1_license_scan": licenses.ORACLE_SQL, "op8_exact_dedup": exact_dedup.ORACLE_SQL, "op11_filter_audit": filter_audit.ORACLE_SQL, "op12_source_divergence": divergence.ORACLE_SQL}
