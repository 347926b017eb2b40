"""Units, physical ranges and text coercion of readings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazegrid.schema import PHYSICAL_MAX, POLLUTANTS, PPM_TO_UGM3

TARGET_UNIT = "µg/m³"


def _lookup(table: dict[str, float], key: Column) -> Column:
    """Value of a small fixed table for each row, as a literal map instead of a join."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(literal, key)


def to_mass_units(value: Column, unit: Column, parameter: Column) -> Column:
    """ppb and ppm readings as µg/m³; readings in other units pass through.

    A gas without a factor keeps its ppm value, as the particulate channels do.
    """
    label = F.lower(unit)
    is_ppb = F.coalesce(label.contains("ppb"), F.lit(False))
    is_ppm = is_ppb | F.coalesce(label == "ppm", F.lit(False))
    ppm = F.when(is_ppb, value / 1000.0).otherwise(value)
    factor = F.coalesce(_lookup(PPM_TO_UGM3, parameter), F.lit(1.0))
    return F.when(is_ppm, ppm * factor).otherwise(value)


def within_physical_range(value: Column, parameter: Column) -> Column:
    """Null where the value is negative or above what a sensor can read."""
    top = _lookup(PHYSICAL_MAX, parameter)
    return F.when((value < 0) | F.coalesce(value > top, F.lit(False)), None).otherwise(value)


def parameter_name(raw: Column) -> Column:
    """``PM2.5 `` -> ``pm25``."""
    return F.trim(F.replace(F.lower(raw), F.lit("."), F.lit("")))


def is_tracked(parameter: Column) -> Column:
    return parameter.isin(*POLLUTANTS)


def to_number(text: Column) -> Column:
    """Double, or null where the text is not a number."""
    return text.try_cast("double")
