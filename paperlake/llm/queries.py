"""The numbered queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

import paperlake.llm as here


def _modules():
    return [
        importlib.import_module(f"{here.__name__}.{m.name}") for m in pkgutil.iter_modules(here.__path__) if m.name not in ("common", "queries")
    ]


def queries() -> dict[str, Callable]:
    found: dict[str, Callable] = {}
    for module in _modules():
        found |= getattr(module, "QUERIES", {})
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found |= getattr(module, "ORACLE_SQL", {})
    return found
