"""Registry of runnable queries with their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from demandgrid.plans.driver_tables import DriverTables
from demandgrid.plans.sql_tables import TABLES

DIGITS = 6
# Added before rounding, so that a value on a decimal tie rounds the same way in
# both engines whatever the last bit of its sum is.
NUDGE = 3e-10


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[DriverTables], DataFrame]
    sql: str | None = None
    doubles: tuple[str, ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(self.plan(DriverTables(spark, sf_dir)))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql
        if self.doubles:
            rounded = ", ".join(f"round({c} + {NUDGE}, {DIGITS}) + 0.0 AS {c}" for c in self.doubles)
            body = f"SELECT * REPLACE ({rounded}) FROM ({body}) AS result"
        return with_tables(body)


def _round(value: Column) -> Column:
    """``round``, by arithmetic where that is exact: ``round`` of a double makes a decimal number of each value.

    Below 2^21 ``NUDGE`` is larger than the error of the product, so no tie is left to ``rint``. Short on purpose: the
    generated code of a wide table must stay below what the JVM compiles.
    """
    return F.when(F.abs(value) < 2.0**21, F.rint(value * 10.0**DIGITS) / 10.0**DIGITS + 0.0).otherwise(F.round(value, DIGITS))


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to fixed digits: engines differ in summation order."""
    fields = df.schema.fields
    return df.select(
        *[
            _round(F.col(f.name) + NUDGE).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in fields
        ]
    )


def with_tables(body: str) -> str:
    """Prefixes the named tables that the statement uses, directly or not."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(TABLES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    if body.lstrip().upper().startswith("WITH"):
        body = f"SELECT * FROM ({body}) AS result"
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in needed) + "\n" + body


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}

    def add(
        self, name: str, plan: Callable[[DriverTables], DataFrame], sql: str | None = None, doubles: str = ""
    ) -> None:
        if name in self.queries:
            raise ValueError(f"duplicate query {name}")
        self.queries[name] = Query(name, plan, sql, tuple(doubles.split()))
