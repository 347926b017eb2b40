"""Spatial joins as equi-joins on tiles.

A station looks only into the tiles its radius touches, so the join is a hash or sort-merge
join on tile numbers. Points at the same place are combined first.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions.geo import EARTH_KM, great_circle_km, tile, unit_vector
from hazegrid.operators.lookup import join_on
from hazegrid.session import cut_lineage

KM_PER_DEGREE = 111.0


def valid_cell(count: Column) -> Column:
    """Cell counts that are data: positive and below the no-data sentinel."""
    return (count > 0) & (count < 1e8)


def _distinct_cells(cells: DataFrame) -> DataFrame:
    """Total count per grid position; copies of a cell are added up before the join. Longitudes run from 0 to 360."""
    return cells.where(valid_cell(F.col("pop"))).groupBy("lat", F.pmod(F.col("lon"), F.lit(360.0)).alias("lon")).agg(F.sum("pop").alias("pop"))


def _within(places: DataFrame, cells: DataFrame, lat_radius: float, lon_radius: Column, inside) -> DataFrame:
    """Per place, the total of the cells for which `inside(lat, lon)` holds; it must hold for a whole tile if it does for its corners.

    Tiles are an eighth of the area's height. A tile that lies inside adds its total, whatever it holds; only the tiles on the
    border are joined with their cells. Tile columns go once around the globe, so that no seam is left at the date line; an area
    that holds a pole looks at all columns."""
    columns = max(8, int(360 / (lat_radius / 4)))
    width, height = 360.0 / columns, lat_radius / 4
    x = F.sequence(tile(F.col("longitude") - lon_radius, width), tile(F.col("longitude") + lon_radius, width))
    spots = places.select("latitude", "longitude").distinct()
    looked = (
        spots.withColumn("_y", F.explode(F.sequence(tile(F.col("latitude") - lat_radius, height), tile(F.col("latitude") + lat_radius, height))))
        .withColumn("_x", F.explode(x)).withColumn("_x", F.pmod("_x", F.lit(columns).cast("long"))).distinct())
    corners = [inside(F.col("_y") * height + i * height, F.col("_x") * width + j * width) for i in (0, 1) for j in (0, 1)]
    looked = looked.withColumn("_whole", reduce(lambda a, b: a & b, corners))
    tiled = cells.withColumns({"_x": F.least(tile(F.col("lon"), width), F.lit(columns - 1)), "_y": tile(F.col("lat"), height)})
    totals = tiled.groupBy("_x", "_y").agg(F.sum("pop").alias("pop"), F.count(F.lit(1)).alias("n"))
    full = looked.where("_whole").join(totals, ["_x", "_y"]).select("latitude", "longitude", "pop", "n")
    border = looked.where("not _whole").join(tiled, ["_x", "_y"]).where(inside(F.col("lat"), F.col("lon"))).select(
        "latitude", "longitude", "pop", F.lit(1).cast("long").alias("n"))
    return full.unionByName(border).groupBy("latitude", "longitude").agg(F.sum("pop").alias("_pop"), F.sum("n").alias("n_cells"))


def _sum_or_default(stations: DataFrame, sums: DataFrame, default: int | None) -> DataFrame:
    out = join_on(stations, sums, ["latitude", "longitude"])
    total = F.floor("_pop").cast("long")
    return out.select(
        "station_id",
        (total if default is None else F.coalesce(total, F.lit(default).cast("long"))).alias("population_catchment"),
        F.coalesce(F.col("n_cells"), F.lit(0)).cast("long").alias("n_cells"))


def population_in_square(stations: DataFrame, cells: DataFrame, radius_km: float, default: int | None = None) -> DataFrame:
    """Sum of valid cells whose centre lies within +-radius in latitude and in longitude, across the date line too."""
    radius = radius_km / KM_PER_DEGREE

    def inside(lat: Column, lon: Column) -> Column:
        apart = F.pmod(F.abs(lon - F.col("longitude")), F.lit(360.0))
        return (F.abs(lat - F.col("latitude")) <= radius) & (F.least(apart, 360.0 - apart) <= radius)

    return _sum_or_default(stations, _within(stations, _distinct_cells(cells), radius * (1 + 1e-9), F.lit(radius * (1 + 1e-9)), inside), default)


def population_in_circle(stations: DataFrame, cells: DataFrame, radius_km: float, default: int | None = None) -> DataFrame:
    """Sum of valid cells within a great-circle radius, anywhere on the globe."""
    angle = radius_km / EARTH_KM * 1.001  # a little wider than the circle, so the tiles cannot lose a cell
    lat = F.radians(F.abs(F.col("latitude")))
    lon_radius = F.when(lat + angle >= math.pi / 2, 180.0).otherwise(F.degrees(F.asin(F.least(math.sin(angle) / F.cos(lat), F.lit(1.0)))))

    def inside(lat: Column, lon: Column) -> Column:
        return great_circle_km(F.col("latitude"), F.col("longitude"), lat, lon) <= radius_km

    return _sum_or_default(stations, _within(stations, _distinct_cells(cells), math.degrees(angle), lon_radius, inside), default)


def nearest_point(
    stations: DataFrame, points: DataFrame, point_id: str, levels: int = 8, fan: int = 8, few: int = 32,
) -> DataFrame:
    """The nearest point of every station, by great-circle distance; ties go to the smaller id.

    Branch and bound over nested cubes around the globe instead of all pairs. A station
    starts with the few occupied top cubes. At each level a cube is dropped when its nearest
    possible point is farther than the farthest possible point of another cube, and the rest
    are split into their occupied sub-cubes, until no cube holds more than `few` points (or, after `levels`, a metre apart).
    The points with their cubes are written to the shared folder once; runs that job.
    """
    axes = ("x", "y", "z")

    def cube(level: int) -> Column:
        side = 2.0 / fan**level
        return F.concat_ws("/", *[F.floor((F.col(a) + 1.0) / side).cast("string") for a in axes])

    place = points.groupBy(F.col("latitude").alias("plat"), F.col("longitude").alias("plon")).agg(
        F.min(point_id).alias(point_id))
    cubes = cut_lineage(
        place.withColumns(dict(zip(axes, unit_vector(F.col("plat"), F.col("plon")))))
        .withColumns({f"_l{i}": cube(i) for i in range(1, levels + 1)}), "cubes")
    for depth in range(2, levels):
        if cubes.groupBy(f"_l{depth}").count().agg(F.max("count")).first()[0] in (None, *range(few + 1)):
            levels = depth
            break
    spot = ("latitude", "longitude", "sx", "sy", "sz")
    start = stations.select("latitude", "longitude").distinct().withColumns(
        dict(zip(spot[2:], unit_vector(F.col("latitude"), F.col("longitude")))))
    top = cubes.agg(F.sort_array(F.collect_set("_l1")).alias("_tops"))  # at most fan**3 names
    found = join_on(start, top, []).withColumn("_l1", F.explode("_tops")).drop("_tops")

    def gap(a: str) -> Column:
        s = F.col(f"s{a}")
        return F.greatest(F.col(f"lo_{a}") - s, s - F.col(f"hi_{a}"), F.lit(0.0))

    def span(a: str) -> Column:
        s = F.col(f"s{a}")
        return F.greatest(F.abs(s - F.col(f"lo_{a}")), F.abs(s - F.col(f"hi_{a}")))

    def squared(f) -> Column:
        return reduce(lambda p, q: p + q, [f(a) * f(a) for a in axes])

    own = Window.partitionBy("latitude", "longitude")  # the open cubes of one place
    for i in range(1, levels + 1):
        name = f"_l{i}"
        boxes = cubes.groupBy(name).agg(
            *[F.min(a).alias(f"lo_{a}") for a in axes], *[F.max(a).alias(f"hi_{a}") for a in axes])
        kept = (
            found.join(boxes, name).withColumns({"_least": squared(gap), "_most": squared(span)})
            .withColumn("_bound", F.min("_most").over(own))
            .where(F.col("_least") <= F.col("_bound") * (1 + 1e-9) + 1e-15).select(*spot, name)
        )
        below = cubes.select(name, f"_l{i + 1}").distinct() if i < levels else cubes.select(name, "plat", "plon", point_id)
        found = kept.join(below, name).drop(name)
    km = great_circle_km(F.col("latitude"), F.col("longitude"), F.col("plat"), F.col("plon"))
    best = found.withColumn("distance_km", F.round(km, 6)).groupBy("latitude", "longitude").agg(
        F.min(F.struct("distance_km", point_id)).alias("_best"))
    return join_on(stations, best, ["latitude", "longitude"]).select(
        "station_id", F.col("_best")[point_id].alias(point_id), F.col("_best.distance_km").alias("distance_km"))
