"""The ten operators' queries and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["decontaminate", "language", "chat", "privacy", "mixing", "revisits", "vectors", "urlrules", "jaccard", "substrings"]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in import_module(f"{__package__}.{m}").SQL.items()}
