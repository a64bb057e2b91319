"""Every registered query of the tree engine."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PARTS = ("scans", "diffs", "histories", "stores")


def _all() -> dict:
    found = {}
    for part in PARTS:
        found |= import_module(f"arbor.plans.{part}").QUERIES
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all()["diff_trees"][0](spark, sf_dir)


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
