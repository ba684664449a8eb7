"""Queries over the driver tables."""

from __future__ import annotations

from .registry import REGISTRY, Query


def load_queries() -> dict[str, Query]:
    """Import every query module once and return the registry."""
    from . import (  # noqa: F401
        balance_queries, contact_queries, match_queries, reconcile_queries, record_queries, report_queries,
        stream_queries, text_queries,
    )

    return REGISTRY
