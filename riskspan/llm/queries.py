"""Queries and oracle SQL of the training-data operators, by registered name."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("sharding", "urls", "decontam", "packing", "quality_rules", "toxicity", "crf", "substrings", "near_dedup", "secrets", "centroids", "one_bit", "prefix_trie")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
