"""Queries by name, each with the DuckDB text that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundphrase.plans.fixtures import DUCK, load

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.parts: dict[str, str] = {}

    def part(self, name: str, sql: str) -> None:
        """A named piece of DuckDB text that other texts of this registry may select from."""
        self.parts[name] = sql

    def add(self, name: str, inputs: str, sql: str | None = None):
        """Registers a function of the named inputs (adapters or tables)."""

        def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.queries[name] = lambda spark, sf_dir: f(*[load(spark, sf_dir, i) for i in inputs.split()])
            if sql is not None:
                self.sql[name] = self.text(sql)
            return f

        return wrap

    def text(self, sql: str) -> str:
        """The text with the adapters and parts that it names, in order of need."""
        pool, found = DUCK | self.parts, {}

        def need(body: str, own: str = "") -> None:
            for name in pool:
                if name != own and name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", body):
                    need(pool[name], name)
                    found[name] = pool[name]

        need(sql)
        recursive = "RECURSIVE " if re.search(r"\bRECURSIVE\b", sql + "".join(found.values())) else ""
        own = re.match(r"\s*WITH\s+(?:RECURSIVE\s+)?(.*)", sql, re.S)
        pieces = [f"{n} AS ({re.sub(r'^\s*/\* RECURSIVE \*/', '', t)})" for n, t in found.items()]
        if own:
            return f"WITH {recursive}{', '.join([*pieces, own[1]])}"
        return f"WITH {recursive}{', '.join(pieces)} {sql}" if pieces else sql
