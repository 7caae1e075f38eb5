"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import decontamination, language_id, lm_scoring, mixing, quality_classifier, secret_scan, simhash_dedup, substring_dedup, token_shards, topk_search

MODULES = (lm_scoring, mixing, language_id, simhash_dedup, substring_dedup, decontamination, secret_scan, token_shards, quality_classifier, topk_search)

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
