"""All registered queries; importing a plan module registers its queries."""

from __future__ import annotations

from importlib import import_module
from importlib.util import find_spec

from marketlens.registry import ORACLE_SQL, QUERIES

PLAN_MODULES = (
    "scans", "outputs", "filters", "projections", "joins", "segments", "effect", "deal", "runs",
    "monitoring", "trends", "texts", "aggregates", "criteria", "ranks", "lookups", "logic",
    "text_columns", "date_columns", "math_columns", "finance", "live",
)


def _load() -> None:
    for module in PLAN_MODULES:
        name = f"marketlens.plans.{module}"
        if find_spec(name):
            import_module(name)


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLE_SQL)
