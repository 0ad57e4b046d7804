"""Queries over the driver tables, each with its SQL twin where plain SQL can say the same."""

from furrow.catalog.base import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
