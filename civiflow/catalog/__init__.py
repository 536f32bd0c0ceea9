"""Registered queries and their DuckDB counterparts, grouped by stage."""
