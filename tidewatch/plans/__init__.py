"""Registered queries."""

from __future__ import annotations


def load():
    """All queries of the library and their SQL, by name."""
    from . import catalog, detector_queries, generator_queries, protocol_queries, record_queries, routing_queries, stream_queries, table_queries  # noqa: F401

    return catalog.QUERIES, catalog.ORACLES
