"""How queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None, digits: int = 6) -> Callable:
        """Registers a function of (spark, sf_dir) under a name, with its SQL if there is one."""

        def add(f: Callable) -> Callable:
            self.queries[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
            if sql:
                self.oracle[name] = sql
            return f

        return add
