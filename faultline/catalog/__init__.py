"""Registered queries, each with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

from faultline.catalog.registry import ORACLES, QUERIES

for _part in ("graph", "traversal", "versions", "precision", "people", "reports", "advisories", "ingest", "streams", "checks"):
    import_module(f"faultline.catalog.{_part}")

__all__ = ["ORACLES", "QUERIES"]
