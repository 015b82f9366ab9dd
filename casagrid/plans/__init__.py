"""Query registry; importing the family modules fills it."""

from __future__ import annotations

import importlib

FAMILIES = (
    "search_queries",
    "market_queries",
    "spatial_queries",
    "text_queries",
    "lifecycle_queries",
    "repair_queries",
    "trace_queries",
    "stream_queries",
    "incident_queries",
    "page_queries",
    "file_queries",
)


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"casagrid.plans.{family}")


def queries():
    _load()
    from casagrid.plans.registry import QUERIES

    return dict(QUERIES)


def oracle_sql():
    _load()
    from casagrid.plans.registry import ORACLE

    return dict(ORACLE)


def coverage():
    _load()
    from casagrid.plans.registry import COVERS

    return dict(COVERS)
