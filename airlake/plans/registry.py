"""Registry of query plans and their DuckDB oracle SQL."""

from __future__ import annotations

import importlib

_MODULES = (
    "q_attribution",
    "q_analysis",
    "q_ingest",
    "q_series",
)


def _mods():
    return [importlib.import_module(f"airlake.plans.{m}") for m in _MODULES]


def all_queries():
    out = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def all_oracle():
    from airlake.plans.base import sql_count_if, sql_round6

    out = {}
    for m in _mods():
        out.update({k: sql_count_if(sql_round6(v)) for k, v in getattr(m, "ORACLE", {}).items()})
    return out
