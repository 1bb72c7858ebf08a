"""Registered queries over the given tables, and the same in SQL for DuckDB."""
