"""Operators for preparing language-model training data.

Nothing else in the library imports this package; ``queries.py`` lists its
registered queries and ``sql.py`` their DuckDB SQL."""
