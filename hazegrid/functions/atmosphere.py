"""Boundary-layer height and wind sectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazegrid.functions.calendar import by_season

# ---- fixed values: seasonal base height in metres, bounds, status bands -----------------
BASE_HEIGHT = {"Winter": 360.0, "Pre-Monsoon": 920.0, "Monsoon": 1680.0, "Post-Monsoon": 680.0}
HEIGHT_RANGE = (120.0, 2700.0)
STATUS = [(400, "⚠️ Severe Nocturnal Trapping"), (900, "Moderate Dispersion")]
TOP_STATUS = "Active Convective Flushing"
SECTOR_DEGREES = 45


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value from below and above; null stays null, unlike bare greatest/least."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(value.isNotNull(), out)


def boundary_layer_height(hour: Column, month: Column, temp_c: Column, wind_kmh: Column) -> Column:
    """Estimated mixing height in metres, one decimal: seasonal base, sun, warmth and wind."""
    base = by_season(month, BASE_HEIGHT)
    sun = clip(F.sin((hour - 6) * F.lit(math.pi) / 12), -0.75, 1.0)
    warmth = clip((temp_c - 20.0) * 12.0, 0.0)
    stirring = clip(wind_kmh * 15.0, 0.0)
    return F.round(clip(base + sun * base * 0.70 + warmth + stirring, *HEIGHT_RANGE), 1)


def height_status(blh: Column) -> Column:
    expr = F.when(blh.isNull(), F.lit(None).cast("string"))
    for upper, text in STATUS:
        expr = expr.when(blh < upper, text)
    return expr.otherwise(TOP_STATUS)


def wind_sector(direction: Column) -> Column:
    """Start of the eight-sector compass direction: 0, 45, ... 315."""
    turned = F.pmod(direction, F.lit(360.0)) + SECTOR_DEGREES / 2
    return F.pmod(F.floor(turned / SECTOR_DEGREES) * SECTOR_DEGREES, F.lit(360)).cast("int")
