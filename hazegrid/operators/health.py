"""Exposure tables, health burden and impact rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.functions import health as H
from hazegrid.functions.calendar import season
from hazegrid.operators.joins import on_domain, per_crf
from hazegrid.operators.lookup import join_on
from hazegrid.operators.ordering import with_rank
from hazegrid.schema import (
    ANNUAL_BASELINE, CITY_POPULATION, CRF_ANNUAL, CRF_DAILY_BETA, DAILY_PM10_BASELINE, MORTALITY_RATE,
    RANKING_BETA, SEASONS,
)

STATION_KEYS = ["station_id", "station_name", "latitude", "longitude"]


# ---- exposure ---------------------------------------------------------------------------

def exposure_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean PM2.5 and mean exposure per key, over rows with PM2.5."""
    score = H.exposure(F.col("pm25"), F.col("population_catchment"))
    return df.where(F.col("pm25").isNotNull()).groupBy(*keys).agg(
        F.avg("pm25").alias("mean_pm25"), F.avg(score).alias("mean_exposure_score"),
        F.max("population_catchment").alias("population_catchment"), F.count(F.lit(1)).alias("n_readings"))


def weighted_exposure_score(df: DataFrame) -> DataFrame:
    """Mean PM2.5 times catchment, in millions, per station."""
    return (
        df.where(F.col("pm25").isNotNull() & F.col("population_catchment").isNotNull())
        .groupBy("station_id")
        .agg(F.avg("pm25").alias("mean_pm25"), F.max("population_catchment").alias("population_catchment"))
        .withColumn("pwe_score", H.exposure_millions(F.col("mean_pm25"), F.col("population_catchment")))
    )


# ---- long-term burden -------------------------------------------------------------------

def station_means(df: DataFrame, keys: list[str] = ["station_id"]) -> DataFrame:
    """Mean PM2.5, mean PM10 and catchment per station over the whole period."""
    return df.groupBy(*keys).agg(
        F.avg("pm25").alias("mean_pm25"), F.avg("pm10").alias("mean_pm10"),
        F.max("population_catchment").alias("catchment_pop"))


def _conc_and_baseline() -> tuple[Column, Column]:
    conc = F.when(F.col("pollutant") == "pm25", F.col("mean_pm25")).when(
        F.col("pollutant") == "pm10", F.col("mean_pm10"))
    base = F.when(F.col("pollutant") == "pm25", ANNUAL_BASELINE["pm25"]).when(
        F.col("pollutant") == "pm10", ANNUAL_BASELINE["pm10"])
    return conc, base


def burden(means: DataFrame, crfs: list[tuple] = CRF_ANNUAL) -> DataFrame:
    """Unrounded attributable risk and deaths per station and response function; stations
    without the pollutant are left out."""
    rows = per_crf(means, crfs)
    conc, base = _conc_and_baseline()
    rows = rows.withColumns({"mean_conc": conc, "who_baseline": base}).where(F.col("mean_conc").isNotNull())
    rows = rows.withColumns({
        "delta_c": H.excess(F.col("mean_conc"), F.col("who_baseline")),
        "ar_pct": H.attributable_risk_pct(F.col("mean_conc"), F.col("beta"), F.col("who_baseline")),
    })
    return rows.withColumns({
        "attrib_deaths": H.attributable_deaths(F.col("catchment_pop"), F.col("ar_pct")),
        "catchment_pop": F.floor(H.catchment_or_share(F.col("catchment_pop"))).cast("long"),
        "exposure_window": F.lit("Annual"),
    })


def burden_table(means: DataFrame, crfs: list[tuple] = CRF_ANNUAL) -> DataFrame:
    """The published table: `burden` with its rounding."""
    keep = [c for c in STATION_KEYS if c in means.columns]
    return burden(means, crfs).select(
        *keep, "crf", "crf_label", "exposure_window", F.upper("pollutant").alias("pollutant"),
        F.round("mean_conc", 2).alias("mean_conc"), "who_baseline", F.round("delta_c", 2).alias("delta_c"),
        F.round("ar_pct", 3).alias("ar_pct"), "catchment_pop", F.round("attrib_deaths", 1).alias("attrib_deaths"))


def burden_by_crf(table: DataFrame) -> DataFrame:
    """Mean risk and deaths, total deaths and total population per response function."""
    return table.groupBy("crf", "crf_label").agg(
        F.avg("ar_pct").alias("mean_ar_pct"), F.avg("attrib_deaths").alias("mean_deaths"),
        F.sum("attrib_deaths").alias("total_deaths"), F.sum("catchment_pop").alias("total_population"))


def burden_range(table: DataFrame) -> DataFrame:
    """Lowest and highest deaths and risk over the response functions, per station."""
    return table.groupBy("station_id").agg(
        F.min("attrib_deaths").alias("deaths_low"), F.max("attrib_deaths").alias("deaths_high"),
        F.min("ar_pct").alias("ar_low"), F.max("ar_pct").alias("ar_high"))


def burden_side_by_side(table: DataFrame, value: str, missing: float | None = None,
                        crfs: list[tuple] = CRF_ANNUAL) -> DataFrame:
    """One column per response function; `missing` replaces absent values."""
    wide = table.groupBy("station_id").pivot("crf", [c[0] for c in crfs]).agg(F.max(value))
    return wide if missing is None else wide.na.fill(missing)


# ---- short-term burden ------------------------------------------------------------------

def daily_excess(df: DataFrame, beta: float = CRF_DAILY_BETA) -> DataFrame:
    """Excess deaths per station and day from daily mean PM10."""
    daily = (
        df.where(F.col("pm10").isNotNull() & F.col("population_catchment").isNotNull())
        .groupBy("station_id", F.to_date("ts").alias("date"))
        .agg(F.avg("pm10").alias("mean_pm10"), F.max("population_catchment").alias("catchment_pop"))
    )
    risk = H.attributable_risk_pct(F.col("mean_pm10"), beta, DAILY_PM10_BASELINE)
    return daily.withColumn("ar_pct", risk).withColumn(
        "excess_deaths_day", H.excess_deaths_per_day(F.col("catchment_pop"), F.col("ar_pct")))


def period_excess(df: DataFrame, beta: float = CRF_DAILY_BETA) -> DataFrame:
    """Sum of daily excess deaths over the days of the data, and their number."""
    return daily_excess(df, beta).groupBy("station_id").agg(
        F.sum("excess_deaths_day").alias("period_excess_deaths_pm10"), F.count(F.lit(1)).alias("n_days"))


def seasonal_city_burden(df: DataFrame, beta: float = RANKING_BETA) -> DataFrame:
    """Season mean, risk and deaths on the city population, in season order."""
    means = df.where(F.col("pm25").isNotNull()).groupBy(season(F.month("ts")).alias("season")).agg(
        F.avg("pm25").alias("mean_pm25"), F.avg("pm10").alias("mean_pm10"), F.count(F.lit(1)).alias("n"))
    risk = H.attributable_risk_pct(F.col("mean_pm25"), beta, ANNUAL_BASELINE["pm25"])
    out = means.withColumn("ar_pm25_pct", risk).withColumn(
        "attrib_deaths_est", F.col("ar_pm25_pct") / 100 * CITY_POPULATION * MORTALITY_RATE)
    return on_domain(out, "season", SEASONS)


def city_weighted_mean(means: DataFrame) -> DataFrame:
    """Population-weighted PM2.5 of the city: stations without PM2.5 add nothing above the
    line, as in a sum that skips nulls."""
    return means.agg(F.try_divide(
        F.sum(F.col("mean_pm25") * F.col("catchment_pop")), F.sum("catchment_pop").cast("double"),
    ).alias("city_weighted_pm25"))


def population_check(population: DataFrame, limit: float = 1.15) -> DataFrame:
    """Sum of catchments against the city, with a flag for overlap."""
    return population.agg(F.sum("population_catchment").alias("catchment_sum")).select(
        "catchment_sum", (F.col("catchment_sum") / CITY_POPULATION).alias("ratio"),
    ).withColumn("overlap", F.col("ratio") > limit)


# ---- ranking ----------------------------------------------------------------------------

def station_seasons(df: DataFrame) -> DataFrame:
    """Means, catchment and count per station and season, over rows with PM2.5 and people."""
    return df.where(F.col("pm25").isNotNull() & F.col("population_catchment").isNotNull()).groupBy(
        "station_id", season(F.month("ts")).alias("season"),
    ).agg(
        F.avg("pm25").alias("mean_pm25"), F.avg("pm10").alias("mean_pm10"),
        F.max("population_catchment").alias("catchment_pop"), F.count(F.lit(1)).alias("n"))


def impact_ranking(df: DataFrame) -> DataFrame:
    """Excess, risk, impact score and competition rank of every station and season."""
    base = ANNUAL_BASELINE["pm25"]
    scored = station_seasons(df).withColumns({
        "delta_c": H.excess(F.col("mean_pm25"), base),
        "ar_pct": F.round(H.attributable_risk_pct(F.col("mean_pm25"), RANKING_BETA, base), 3),
        "health_impact_score": H.impact_score(F.col("mean_pm25"), F.col("catchment_pop")),
    })
    return with_rank(scored, "health_impact_score", "rank")


def ranking_rollup(ranking: DataFrame) -> DataFrame:
    """Ranking summed by station and by season in one pass; the other key is null."""
    expanded = ranking.groupingSets(
        [[F.col("station_id")], [F.col("season")]], F.col("station_id"), F.col("season"))
    return expanded.agg(
        F.avg("mean_pm25").alias("mean_pm25"), F.avg("ar_pct").alias("ar_pct"),
        F.sum("health_impact_score").alias("health_score"))


def score_matrix(ranking: DataFrame) -> DataFrame:
    """Station by season scores with their row total; order by it where the rows are shown."""
    wide = ranking.groupBy("station_id").pivot("season", SEASONS).agg(F.avg("health_impact_score"))
    wide = wide.withColumnsRenamed({s: s.lower().replace("-", "_") for s in SEASONS})
    names = [s.lower().replace("-", "_") for s in SEASONS]
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0.0)) for n in names])
    return wide.withColumn("row_total", total)


def rank_divergence(ranking: DataFrame) -> DataFrame:
    """Station rank by impact against rank by raw PM2.5, and the difference."""
    by_station = ranking.groupBy("station_id").agg(
        F.round(F.sum("health_impact_score"), 6).alias("health_score"),
        F.round(F.avg("mean_pm25"), 6).alias("mean_pm25"))
    both = with_rank(with_rank(by_station, "health_score", "health_rank"), "mean_pm25", "raw_rank")
    return both.withColumn("rank_shift", F.col("raw_rank") - F.col("health_rank"))


def all_season_view(ranking: DataFrame) -> DataFrame:
    """One row per station: mean of the metrics, best rank."""
    return ranking.groupBy("station_id").agg(
        F.avg("mean_pm25").alias("mean_pm25"), F.max("catchment_pop").alias("catchment_pop"),
        F.avg("delta_c").alias("delta_c"), F.avg("ar_pct").alias("ar_pct"),
        F.avg("health_impact_score").alias("health_impact_score"), F.min("rank").alias("rank"))


METRICS = ["health_impact_score", "mean_pm25", "ar_pct", "attrib_deaths", "catchment_pop"]


def select_metric(view: DataFrame, metric: str) -> DataFrame:
    """The view with the chosen metric as ``metric_val``."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; choose one of {METRICS}")
    return view.withColumn("metric_val", F.col(metric).cast("double"))
