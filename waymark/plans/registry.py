"""All registered queries with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "steps_nested_features"

#: Modules of this package that hold QUERIES: name -> (function, SQL or None).
MODULES = ("records", "evaluation", "relations", "resampling", "texts", "learning", "contracts")


def _all() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"waymark.plans.{name}").QUERIES
    return found


def queries() -> dict:
    return {name: function for name, (function, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
