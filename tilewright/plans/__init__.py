"""Registered queries: a callable (spark, sf_dir) and the SQL of its oracle, or None."""

from __future__ import annotations

from importlib import import_module

MODULES = ("tiles", "vectors", "classes", "relational", "grouped", "refine", "decoding", "linking", "blocks", "design", "labels", "more")


def registered() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f".{name}", __name__).QUERIES
    return found
