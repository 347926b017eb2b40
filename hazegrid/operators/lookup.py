"""Null-safe joins and skew-proof lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_on(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", null_safe: bool = False,
) -> DataFrame:
    """Equi-join on same-named keys, keeping the left ones.

    No side is hinted. Adaptive execution broadcasts a side once its measured size is below
    the threshold, and otherwise splits the partitions of hot keys. Plain equality lets the
    join reuse a partitioning on the same keys; ``null_safe`` gives that up so that null keys
    match each other. Without keys, `right` is a single row and is read as a scalar subquery.
    """
    if not keys:
        row = right.select(F.struct(*right.columns).alias("_row")).scalar()
        extra = right.columns
        return left.withColumn("_row", row).select(*left.columns, *[F.col("_row")[c].alias(c) for c in extra])
    if not null_safe:
        return left.join(right, keys, how)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of `left` that `right` lacks."""
    return join_on(left.select(*keys).distinct(), right.select(*keys).distinct(), keys, "left_anti", null_safe=True)


def dedupe(df: DataFrame, keys: list[str], prefer: list) -> DataFrame:
    """One row per key: the smallest by `prefer`, then by every other column.

    A task keeps one row per key before the shuffle, so a key with very many copies costs no more than one row per task.
    Nulls sort first. Put the most varied key first.
    """
    rest = [c for c in df.columns if c not in keys]
    best = Window.partitionBy(*keys).orderBy(*prefer, *[F.col(c) for c in rest])
    return df.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")
