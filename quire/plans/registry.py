"""Every registered query over the driver's tables, with its DuckDB SQL, by kind."""

from quire.plans import aggregates, changes, columns, edits, filters, lookups, moments, orders, rules, sequences, sources  # noqa: F401  each registers its queries
from quire.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
