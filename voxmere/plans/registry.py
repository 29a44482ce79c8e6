"""All voxel-side queries by id, with their DuckDB equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from voxmere.sources.views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
MODULES = ("volumes", "intensity", "overlap", "runs", "jobs", "files", "annotations", "surfaces", "learning", "streams")


def query(name: str, *views: str, sql: str | None = None):
    """Register a query, and its SQL over the named views where there is one."""

    def register(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return function

    return register


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"voxmere.plans.{module}")
