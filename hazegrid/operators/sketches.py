"""Distinct counts and quantiles kept as small mergeable sketches, so that a new day adds to them without the old rows being read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.schema import CLIP_K

# 2^14 registers: a standard error of 0.6 percent. A KLL sketch of this size errs by about half a percent of the ranks.
REGISTERS, SIZE = 14, 600


def distinct_sketches(df: DataFrame, keys: list[str | Column], value: str, registers: int = REGISTERS) -> DataFrame:
    """One sketch (``sketch``, binary) of the distinct values per key; nulls are not counted."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, registers).alias("sketch"))


def united(stored: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch per key for all stored ones, in one step or in several. Its estimate depends a little on the steps, within the standard error."""
    return stored.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_counts(stored: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Estimated number of distinct values per key over all stored sketches."""
    return united(stored, keys).select(*keys, F.hll_sketch_estimate("sketch").alias(name))


def quantile_sketches(df: DataFrame, keys: list[str | Column], value: str, size: int = SIZE) -> DataFrame:
    """One sketch (``sketch``, binary) of the values per key, and their number ``n``; nulls are left out."""
    known = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    return known.groupBy(*keys).agg(F.kll_sketch_agg_double("_v", size).alias("sketch"), F.count("_v").alias("n"))


def quantiles(stored: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Quantiles and number of values per key over all stored sketches, e.g. ``{"q1": 0.25}``."""
    merged = stored.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("_s"), F.sum("n").alias("n"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(share)).alias(name) for name, share in shares.items()])


def fences(stored: DataFrame, keys: list[str], k: float = CLIP_K) -> DataFrame:
    """q1, q3 and the bounds `k` quartile ranges beyond them, per key over all stored sketches."""
    q = quantiles(stored, keys, {"q1": 0.25, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * k
    return q.withColumns({"lower": F.col("q1") - reach, "upper": F.col("q3") + reach})
