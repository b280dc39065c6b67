"""The book of registered queries: operator id -> query over the domain, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from risklake.plans.domain import Domain, with_views


class Book:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, extra: dict[str, str] | None = None):
        """Register a function of a Domain under an operator's id."""

        def register(make: Callable[[Domain], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: make(Domain(spark, sf_dir))
            if sql is not None:
                self.sql[name] = with_views(sql, extra)
            return make

        return register
