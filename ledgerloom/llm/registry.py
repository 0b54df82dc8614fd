"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontamination, hilbert_shards, jaccard_join, language_id, packed_tokens, personal_data, quality_rules, ranked_search, secret_scan, source_mixing, spelling_variants, token_counts, vector_forest

MODULES = (quality_rules, token_counts, secret_scan, decontamination, language_id, packed_tokens, personal_data, source_mixing, hilbert_shards, jaccard_join, spelling_variants, vector_forest, ranked_search)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
