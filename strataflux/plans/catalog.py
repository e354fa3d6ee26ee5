"""Loads every family so that its queries are registered."""

from __future__ import annotations

from strataflux.plans import block_queries, conformance_queries, live_queries, numeric_queries, pixel_queries, run_queries, source_queries, stream_queries  # noqa: F401
from strataflux.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
