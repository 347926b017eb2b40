"""Station names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: suffixes that network operators append to names ----------------------
NAME_SUFFIXES = [
    " | Dhaka | Smart Air Bangladesh",
    " | Dhaka l Smart Air Bangladesh",
    " l Smart Air Bangladesh",
]


def clean_name(name: Column, suffixes: list[str] = NAME_SUFFIXES) -> Column:
    """Name without operator suffixes and surrounding quotes or blanks."""
    out = name
    for suffix in suffixes:
        out = F.replace(out, F.lit(suffix), F.lit(""))
    return F.btrim(out, F.lit("\"' "))


def short_name(name: Column) -> Column:
    """Text before the first comma."""
    return F.split_part(name, F.lit(","), F.lit(1))


def first_keyword(text: Column, table: list[tuple], default: tuple) -> Column:
    """Struct(label, amount) of the first `table` row (keyword, label, amount) whose keyword
    occurs in the text, whatever its case; `default` (label, amount) if none does.

    The table is a fixed list, so this is one expression and needs no theta join.
    """
    low = F.lower(text)

    def pair(label, amount) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(amount).cast("long").alias("amount"))

    expr = None
    for word, label, amount in table:
        hit = low.contains(word)
        expr = F.when(hit, pair(label, amount)) if expr is None else expr.when(hit, pair(label, amount))
    return expr.otherwise(pair(*default))
