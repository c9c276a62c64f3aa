"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

import tonelake.plans as plans
from tonelake.plans.registry import QUERIES, Query


def load() -> dict[str, Query]:
    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"tonelake.plans.{module.name}")
    return QUERIES
