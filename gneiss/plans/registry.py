"""Where queries and their SQL are kept, and how they are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded."""
    return df.select(*[(F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def register(name: str, sql: str | None = None, digits: int = 6):
    def add(f):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d), digits)
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def rd(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"
