"""All queries of this package and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["topn", "components", "packing", "leaks", "splits", "neighbours", "clusters", "languages", "ocr"]


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"quire.llm.{name}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
