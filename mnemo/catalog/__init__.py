"""All registered queries."""

from mnemo.catalog import (  # noqa: F401
    event_queries, ranking_queries, request_queries, store_queries, text_queries,
)
from mnemo.catalog.base import REGISTRY

__all__ = ["REGISTRY"]
