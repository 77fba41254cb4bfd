"""Registered queries: one module per area, each query with its DuckDB oracle (see base)."""
