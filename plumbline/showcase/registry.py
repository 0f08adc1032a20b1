"""Collects the queries of all areas: name -> (function, SQL statement or None)."""

from __future__ import annotations

import importlib

from .views import oracle

AREAS = ("ranking", "sequences", "controls", "structures", "targets", "measurement",
         "evaluation", "records", "files", "progress")


def _all() -> dict:
    found: dict = {}
    for area in AREAS:
        try:
            module = importlib.import_module(f"{__package__}.{area}")
        except ModuleNotFoundError as missing:
            if missing.name != f"{__package__}.{area}":
                raise
            continue
        clash = set(found) & set(module.QUERIES)
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        found.update(module.QUERIES)
    return found


def queries() -> dict:
    return {name: fn for name, (fn, _sql) in _all().items()}


def oracle_sql() -> dict:
    return {name: oracle(sql) for name, (_fn, sql) in _all().items() if sql}
