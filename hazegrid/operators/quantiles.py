"""Exact interpolated quantiles that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.operators.ordering import cumulative_counts
from hazegrid.session import cut_lineage


def melt(df: DataFrame, keys: list[str], cols: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """Columns to rows."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, cols, name, value)


def value_counts(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How often each value ``_v`` occurs in its group (``_n``); null counts as a value.

    Counting combines before the shuffle. The counts are read several times by what follows,
    so they are written to the shared folder; runs one job.
    """
    counts = long.groupBy(F.col(value).alias("_v"), *keys).agg(F.count(F.lit(1)).alias("_n"))
    return cut_lineage(counts, "value-counts")


def quantiles_of_counts(counts: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """One row per group with linearly interpolated quantiles, e.g. ``{"q1": 0.25}``."""
    placed = cumulative_counts(counts.where(F.col("_v").isNotNull()), keys)
    # Zero-based ranks next to each share; the fraction between them is interpolated.
    place = {n: F.lit(share) * (F.col("_total") - 1) for n, share in shares.items()}

    def at(rank):
        return F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_end")), F.col("_v")))

    picked = placed.groupBy(*keys, "_total").agg(
        *[at(F.floor(place[n])).alias(f"_lo_{n}") for n in shares],
        *[at(F.ceil(place[n])).alias(f"_hi_{n}") for n in shares])
    return picked.select(*keys, *[
        (F.col(f"_lo_{n}") + (place[n] - F.floor(place[n])) * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n)
        for n in shares])


def exact_quantiles(long: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles per group from one pass over the rows.

    ``percentile`` would gather every distinct value of a group in one aggregation buffer;
    here no task holds more than a 256th of them.
    """
    return quantiles_of_counts(value_counts(long, keys, value), keys, shares)
