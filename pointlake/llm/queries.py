"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pointlake.llm import chat, decontamination, divergence, html, language, lines, near, packing, runs, sharding, tokens, topk, toxicity

_MODULES = [chat, decontamination, divergence, html, language, lines, near, packing, runs, sharding, tokens, topk, toxicity]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
