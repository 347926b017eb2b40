"""Distances on the globe and tile keys for spatial equi-joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazegrid.schema import BBOX

EARTH_KM = 6371.0


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_KM)


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere. Straight-line distance between such points grows with
    great-circle distance, and has no seam at the poles or the date line."""
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def tile(coord: Column, size: float) -> Column:
    return F.floor(coord / size).cast("long")


def inside_box(lat: Column, lon: Column, box: dict[str, float] = BBOX) -> Column:
    """Both coordinates within the box, edges included."""
    return lat.between(box["lat_min"], box["lat_max"]) & lon.between(box["lon_min"], box["lon_max"])
