"""Training-data operators over text, vectors, pages and conversations.

Every module holds one operator with a general interface and, below it, the thin registered query.
Nothing outside this package imports it.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from pkgutil import iter_modules

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def load_all() -> None:
    for m in iter_modules(__path__):
        import_module(f"{__name__}.{m.name}")
