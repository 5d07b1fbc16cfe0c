"""Registered queries of the reference operators, by family, each with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession


def _families():
    return [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__)]


def queries() -> dict:
    found: dict = {}
    for family in _families():
        found |= family.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for family in _families():
        found |= family.ORACLE
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["query_having"](spark, sf_dir)
