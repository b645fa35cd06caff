"""Thin registered queries: operators applied to relations derived from the driver tables."""

from __future__ import annotations

import importlib
import pkgutil

from folioscan.registry import ORACLE_SQL, QUERIES, Query


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and all SQL, after importing every module of this package."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return QUERIES, ORACLE_SQL
