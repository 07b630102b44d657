"""All queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from wordloom.llm import boilerplate, chunking, encoding, mixing, neardup, packing, scans, sentences, truncation

_MODULES = (truncation, boilerplate, scans, encoding, chunking, neardup, packing, mixing, sentences)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
