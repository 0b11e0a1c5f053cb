"""All queries over the board operators, with SQL twins for DuckDB."""

from __future__ import annotations

import importlib

#: Modules that offer QUERIES (name -> function of spark, sf_dir) and SQL (name -> DuckDB text).
MODULES = ("connectivity", "measures", "layout", "records", "forms", "views", "outlines", "drawings")
FLAGSHIP = "net_components"


def _merged(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(importlib.import_module(f"tracewright.plans.{name}"), attribute))
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
