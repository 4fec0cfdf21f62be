"""Registered queries and their DuckDB equivalents."""
