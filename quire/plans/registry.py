"""All queries of the core and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["skewed_keys", "relational", "retrieval", "graphs", "datasets", "texts", "pages", "io", "words", "listings"]
FLAGSHIP = "j13_knn_overall"


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"quire.plans.{name}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
