"""Registered queries: each module holds QUERIES (Spark) and SQL (the same result in DuckDB)."""
