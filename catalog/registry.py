"""Catalogue of runnable queries: a Spark callable and, where SQL can say it, its SQL."""

from __future__ import annotations

import importlib
import re
from dataclasses import dataclass
from typing import Callable

_QUERIES: dict[str, "Query"] = {}
_CTES: dict[str, str] = {}
_MODULES = ["base", "panels", "targets", "features", "market", "graphs", "fixtures",
            "selectors", "metrics", "resampling", "search", "models", "audits", "blends", "research"]


@dataclass
class Query:
    name: str
    run: Callable
    sql: str | None


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = Query(name, fn, with_ctes(sql) if sql else None)
        return fn
    return wrap


def cte(name: str, body: str) -> None:
    if name in _CTES:
        raise ValueError(f"duplicate CTE {name}")
    _CTES[name] = body.strip()


def _needed(text: str, seen: dict[str, None]) -> None:
    for name in sorted(set(re.findall(r"\bt_\w+", text))):
        if name in _CTES and name not in seen:
            _needed(_CTES[name], seen)
            seen[name] = None


def with_ctes(sql: str) -> str:
    """Prefix the statement with the shared CTEs it mentions, in dependency order."""
    seen: dict[str, None] = {}
    _needed(sql, seen)
    if not seen:
        return sql.strip()
    head = ",\n".join(f"{n} as materialized ({_CTES[n]})" for n in seen)
    sql = sql.strip()
    if sql.lower().startswith("with "):
        return f"with {head},\n{sql[5:]}"
    return f"with {head}\n{sql}"


def load() -> dict[str, Query]:
    for m in _MODULES:
        importlib.import_module(f"catalog.{m}")
    return dict(_QUERIES)
