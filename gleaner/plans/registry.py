"""All registered queries of the package outside of the training-data folder."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans.views import Views

MODULES = ("retrieval_queries", "catalog_queries", "telemetry_queries", "evidence_queries", "text_queries", "pack_queries")


def _all() -> dict[str, tuple[Callable[[Views], DataFrame], str | None]]:
    out = {}
    for m in MODULES:
        out |= import_module(f"gleaner.plans.{m}").Q
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf, f=f: f(Views(spark, sf))) for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
