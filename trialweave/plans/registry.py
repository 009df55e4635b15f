"""Registered queries of the table engine, each with the SQL that says the same."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["merges", "links", "tables", "scalars", "analytics", "documents", "sources"]

QUERIES: dict = {}
SQL: dict = {}
for _m in _MODULES:
    _module = import_module(f"{__package__}.{_m}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
