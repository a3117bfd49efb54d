"""Registered queries."""

from __future__ import annotations

import importlib
import pkgutil
from functools import wraps

from gleaner.plans import registry
from gleaner.session import apply_defaults


def _load() -> None:
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")


def _with_defaults(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        apply_defaults(spark)
        return fn(spark, sf_dir)

    return run


def queries():
    _load()
    return {name: _with_defaults(fn) for name, fn in registry.QUERIES.items()}


def oracle_sql():
    _load()
    return dict(registry.ORACLES)
