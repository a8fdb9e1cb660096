"""The registered queries, gathered from the modules of strataline.plans."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataline import plans


def _modules():
    for info in sorted(pkgutil.iter_modules(plans.__path__), key=lambda x: x.name):
        yield importlib.import_module(f"{plans.__name__}.{info.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _modules() for name, query in getattr(module, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
