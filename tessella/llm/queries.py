"""The queries of this package and their SQL, by name."""

from __future__ import annotations

import importlib

MODULES = ("linkage", "topn", "grouping", "names", "quantiles", "neardup", "survivors", "tokens", "packing", "mojibake")


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{name}"), what)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
