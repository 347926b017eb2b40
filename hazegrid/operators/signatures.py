"""Aggregates of source scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.signatures import dominant_label, relative_shares
from hazegrid.operators.joins import on_domain
from hazegrid.operators.lookup import join_on
from hazegrid.schema import SEASONS, SOURCES

UNKNOWN_SOURCE = "Construction & Vehicular Traffic"


def by_station_season(scored: DataFrame) -> DataFrame:
    return scored.groupBy("station_id", "season").agg(
        *[F.avg(s).alias(s) for s in SOURCES], F.count(F.lit(1)).alias("n_readings"))


def season_profile(station_season: DataFrame) -> DataFrame:
    """Mean of the station means per season, in season order."""
    means = station_season.groupBy("season").agg(*[F.avg(s).alias(s) for s in SOURCES])
    return on_domain(means, "season", SEASONS)


def station_profile(station_season: DataFrame) -> DataFrame:
    """Mean of the season means per station."""
    return station_season.groupBy("station_id").agg(*[F.avg(s).alias(s) for s in SOURCES])


def station_shares(station_season: DataFrame) -> DataFrame:
    return station_profile(station_season).select(
        "station_id", *[c.alias(n) for n, c in relative_shares().items()])


def dominant_sources(stations: DataFrame, station_season: DataFrame) -> DataFrame:
    """Readable main source of every station; stations without scores get a general label."""
    c = F.col
    label = dominant_label(c("score_brick_kiln"), c("score_construction"), c("score_traffic"))
    named = station_profile(station_season).select("station_id", label.alias("dominant_source"))
    return join_on(stations.select("station_id"), named, ["station_id"]).withColumn(
        "dominant_source", F.coalesce("dominant_source", F.lit(UNKNOWN_SOURCE)))
