"""All queries and oracles of this package, collected from the modules of ``plans``."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import tremora.plans
from tremora.plans.registry import QUERIES, SQL


def _load() -> None:
    for module in pkgutil.iter_modules(tremora.plans.__path__):
        importlib.import_module(f"tremora.plans.{module.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
