"""Registration of queries beside the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(fn: Callable[[SparkSession, str], DataFrame]):
            self.queries[name] = fn
            if sql:
                self.oracles[name] = sql
            return fn

        return add
