"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from . import attention_mil, block_ann, decontaminate, geometric_postings, hashed_maxent, hilbert_negatives, jaccard_join, language_filters, mixing, pii_bootstrap, simple8b, suffix_dedup, token_counts

MODULES = [block_ann, jaccard_join, decontaminate, pii_bootstrap, token_counts, suffix_dedup, mixing, attention_mil, language_filters, simple8b, geometric_postings, hashed_maxent, hilbert_negatives]

QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
