"""The engine's own queries and their SQL, by name."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("corpus", "resolution", "adjudication", "network", "evidence", "search", "measures", "scores", "contexts", "checks", "cases")


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.plans.{name}"), what)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
