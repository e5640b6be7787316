"""Queries over a folder of tables, with their DuckDB oracles."""
