"""All registered queries of the engine, each with its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundphrase.plans.counting import counting
from groundphrase.plans.exchanging import exchanging
from groundphrase.plans.pictures import pictures
from groundphrase.plans.rules import rules
from groundphrase.plans.selecting import selecting

REGISTRIES = [rules, selecting, counting, pictures, exchanging]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for r in REGISTRIES for name, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in REGISTRIES for name, sql in r.sql.items()}
