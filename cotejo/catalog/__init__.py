"""All registered queries with their oracle SQL, grouped by family."""

from __future__ import annotations

import importlib

FAMILIES = ("voting", "columns", "reconcile", "layout", "accounts", "lookups", "streams", "stores")


def registry() -> dict:
    out: dict = {}
    for family in FAMILIES:
        module = importlib.import_module(f"cotejo.catalog.{family}")
        clash = out.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out.update(module.QUERIES)
    return out
