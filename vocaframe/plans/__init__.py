"""Registered queries over the driver's tables, their stand-in inputs and
their DuckDB oracle SQL."""
