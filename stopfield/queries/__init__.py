"""The registered queries: every operator on the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
import pkgutil

from stopfield.queries.registry import ORACLES, QUERIES, ROWS

__all__ = ["ORACLES", "QUERIES", "ROWS", "load_all"]


def load_all() -> None:
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
