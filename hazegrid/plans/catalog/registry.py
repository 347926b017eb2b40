"""Registry of queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.plans.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def settled(df: DataFrame, rounds: dict[str, int]) -> DataFrame:
    """Computed doubles in single precision, because two engines add up doubles in different orders, and without the noise of sums
    that cancel out; 32-bit integers widened; names and order kept.

    Decimal digits alone would not do: means of decimals often end in an exact 5, where the engines' rounding parts."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name in rounds:
            c = F.round(c, rounds[field.name] + 4).cast("float").cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, rounds: dict[str, int] | None = None):
    """Register ``f(tables) -> DataFrame`` under `name`."""
    rounds = rounds or {}

    def register(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: settled(f(Tables(spark, sf_dir)), rounds)
        if sql is not None:
            swaps = ", ".join(f"(round({c}, {d + 4}) + 0.0::double)::float::double as {c}" for c, d in rounds.items())
            ORACLES[name] = f"select * replace ({swaps}) from (\n{sql}\n) checked" if swaps else sql
        return f

    return register
