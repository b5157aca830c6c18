"""Where queries and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(*names: str, to: int = 6) -> list[Column]:
    return [F.round(F.col(n), to).alias(n) for n in names]


def take(df: DataFrame, plain: str, numbers: str = "", to: int = 6) -> DataFrame:
    """These columns, the numbers rounded."""
    return df.select(*plain.split(), *rounded(*numbers.split(), to=to))


def sql_take(source: str, plain: str, numbers: str = "", to: int = 6) -> str:
    return "SELECT " + ", ".join([*plain.split(), *(f"round({n}, {to}) AS {n}" for n in numbers.split())]) + f" FROM {source}"
