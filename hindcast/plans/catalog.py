"""Importing a query module registers its queries; this imports all of them."""

from hindcast.plans import (  # noqa: F401
    decision_queries,
    feature_queries,
    history_queries,
    model_queries,
    quality_queries,
    split_queries,
    stream_queries,
    table_queries,
)
from hindcast.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
