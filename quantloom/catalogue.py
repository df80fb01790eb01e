"""All queries of the library, but those of optional parts."""

from __future__ import annotations

from quantloom import queries as first
from quantloom import queries_execution, queries_experiments, queries_gates, queries_models, queries_portfolio, queries_reads, queries_regime, queries_reviews, queries_signals, queries_structure, queries_valuation  # noqa: F401  they register themselves

queries, oracle_sql = first.queries, first.oracle_sql
