"""The queries of this subpackage and the SQL of those that SQL can state."""

from __future__ import annotations

from docmeter.llm import abuse, consensus, cut, encode, mixing, names, pairs

MODULES = [pairs, cut, consensus, names, encode, mixing, abuse]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in getattr(module, "SQL", {}).items()}
