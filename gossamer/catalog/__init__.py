"""Registered queries: each reads the driver tables through the adapter; most carry an equivalent SQL text."""

from gossamer.catalog.registry import QUERIES, load_all, sql_texts

__all__ = ["QUERIES", "load_all", "sql_texts"]
