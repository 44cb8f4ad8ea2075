"""Named queries over the benchmark tables, with the SQL text that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netloom.plans.fixtures import duck, table
from netloom.session import new_folder


@dataclass(frozen=True)
class Query:
    name: str
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(*[table(spark, sf_dir, name) for name in self.inputs])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        given = duck(*self.inputs)
        text = self.sql.strip()
        word = "WITH "
        for start in ("WITH RECURSIVE ", "WITH "):
            if text.startswith(start):
                word, text = start, ", " + text[len(start):] if given else text[len(start):]
                break
        else:
            if not given:
                return text
        return f"{word}{given}\n{text}"


QUERIES: dict[str, Query] = {}


def query(name: str, *inputs: str, sql: str | None = None):
    """Register ``build(*inputs)``; ``sql`` may start with its own WITH clause."""
    def add(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, inputs, build, sql)
        return build
    return add


def r6(value: str | Column) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: r6(name) for name in names})


def scratch(spark: SparkSession) -> str:
    """A new folder for data a query writes and reads back."""
    return new_folder(spark)
