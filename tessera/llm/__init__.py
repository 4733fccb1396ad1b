"""Operators for preparing language-model training data.

Nothing else in the library imports this package.  Each ``opN`` module holds
one operator, its thin query over the synthetic tables and, where SQL can
express it, the DuckDB statement that returns the same rows.
"""

from __future__ import annotations


def queries():
    """All queries of this package, by name."""
    from . import registry

    return registry.queries()


def oracle_sql():
    """DuckDB statements of those queries that SQL can express."""
    from . import registry

    return registry.oracle_sql()
