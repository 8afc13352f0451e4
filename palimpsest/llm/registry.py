"""Queries of this subpackage for __spark_entry__.py, and their SQL where SQL can express them."""

from __future__ import annotations

from palimpsest.llm import ann, divergence, line_dedup, mixing, near_dup, packing, periodic, quality, secret_scan, substring_dedup, suffix_dedup, token_store, url_filter

QUERIES = {
    "op1_nearest": ann.op1_nearest,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_token_store": token_store.op8_token_store,
    "op9_best_fit_pack": packing.op9_best_fit_pack,
    "op10_near_dup": near_dup.op10_near_dup,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}
ORACLE_SQL = {
    "op5_line_dedup": line_dedup.SQL,
    "op11_source_divergence": divergence.SQL,
}
