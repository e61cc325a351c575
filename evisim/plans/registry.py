"""Collects the queries of the plan modules: each has QUERIES, a dict of name -> (function, SQL or None)."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

import evisim.plans as plans

Query = Callable[[SparkSession, str], DataFrame]


@cache
def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for info in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        module = importlib.import_module(f"{plans.__name__}.{info.name}")
        for name, pair in getattr(module, "QUERIES", {}).items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = pair
    return found


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
