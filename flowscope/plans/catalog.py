"""All registered queries on recordings and graphs, and the SQL each is checked against."""

from __future__ import annotations

import importlib

MODULES = ("graph_queries", "element_queries", "frame_queries", "timeline_queries", "analysis_queries", "state_queries", "document_queries")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"flowscope.plans.{m}"), name)
    return out


def queries():
    return _all("QUERIES")


def oracle_sql():
    return _all("ORACLE")
