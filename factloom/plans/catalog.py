"""All queries of the engine by name, and the SQL that says the same."""

from __future__ import annotations

from . import queries_ledger, queries_series, queries_tables

QUERIES: dict = queries_series.QUERIES | queries_tables.QUERIES | queries_ledger.QUERIES
ORACLES: dict = queries_series.ORACLES | queries_tables.ORACLES | queries_ledger.ORACLES
