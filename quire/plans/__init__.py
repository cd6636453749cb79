"""The engine's registered queries."""

from quire.plans import derived_queries, layout_queries, store_queries, stored_queries, table_queries, text_queries, textlayer_queries  # noqa: F401
from quire.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
