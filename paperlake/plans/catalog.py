"""Every query of the library by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from . import collections, graphs, papers, searches, texts, views

MODULES = (searches, papers, graphs, texts, collections, views)


def queries() -> dict[str, Callable]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
