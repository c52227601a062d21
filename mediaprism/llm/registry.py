"""The queries of this subpackage and their SQL; the entry point adds the pipeline."""

from __future__ import annotations

from . import crosspolytope, cube, extraction, packing, quality, simhash, substrings, tokens, toxicity, urlrules

QUERIES = {
    "op1_html_extraction": extraction.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_mixing": cube.query,
    "op4_nearest_neighbours": crosspolytope.query,
    "op5_quality_rules": quality.query,
    "op6_toxicity": toxicity.query,
    "op7_substring_dedup": substrings.query,
    "op8_token_counts": tokens.query,
    "op9_best_fit_packing": packing.query,
    "op10_url_filters": urlrules.query,
}
ORACLE_SQL = {"op5_quality_rules": quality.ORACLE_SQL, "op10_url_filters": urlrules.ORACLE_SQL}
