"""Registered queries: each operator on the supplied tables, with the SQL that states the same result."""

from __future__ import annotations

import importlib

from checks.base import QUERIES, SQL

for _name in ("series", "invariant", "compare", "observe", "result", "metadata", "text", "source", "session", "published"):
    importlib.import_module(f"checks.{_name}_queries")

__all__ = ["QUERIES", "SQL"]
