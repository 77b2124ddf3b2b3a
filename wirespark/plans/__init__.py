"""Registered queries over the driver's tables, and their SQL."""

import importlib

_MODULES = ["traffic", "text", "network", "more"]


def _load():
    for name in _MODULES:
        importlib.import_module(f"wirespark.plans.{name}")
    from wirespark.plans import registry

    return registry


def queries() -> dict:
    return dict(_load().QUERIES)


def oracle_sql() -> dict:
    return dict(_load().SQL)
