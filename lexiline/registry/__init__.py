"""Registered queries, one module per area."""

from __future__ import annotations

import importlib

AREAS = ("sources", "text", "filters", "detect", "timeline", "evidence", "reports", "align", "patterns", "catalog", "usage", "streams", "jobs", "fusion")


def all_queries():
    from lexiline.registry import base

    for area in AREAS:
        importlib.import_module(f"lexiline.registry.{area}")
    return dict(base.QUERIES)
