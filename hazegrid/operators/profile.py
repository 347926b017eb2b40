"""Data-quality reports and descriptive profiles. Each is one pass of mergeable aggregates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions import aqi
from hazegrid.functions.atmosphere import wind_sector
from hazegrid.functions.calendar import day_type, hour_of, season
from hazegrid.operators.joins import on_domain
from hazegrid.operators.lookup import join_on
from hazegrid.operators.quantiles import melt, quantiles_of_counts, value_counts
from hazegrid.schema import DAILY_LIMITS, POLLUTANTS, SEASONS, WEATHER


def _pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def _rows(fields: dict[str, dict[str, Column]], key: str) -> Column:
    """Turn one row of aggregates into one row per label."""
    return F.explode(F.array(*[
        F.struct(F.lit(label).alias(key), *[c.alias(n) for n, c in cols.items()])
        for label, cols in fields.items()])).alias("_r")


def quality_report(wide: DataFrame) -> DataFrame:
    """Valid count, completeness, mean, max, daily limit and exceedance per pollutant."""
    stats = wide.agg(
        F.count(F.lit(1)).alias("_total"),
        *[f(p).alias(f"{n}_{p}") for p in POLLUTANTS
          for n, f in (("valid", F.count), ("mean", F.avg), ("max", F.max))])
    fields = {p: {
        "valid_records": F.col(f"valid_{p}"),
        "completeness_pct": F.coalesce(_pct(F.col(f"valid_{p}"), F.col("_total")), F.lit(0.0)),
        "mean_value": F.coalesce(F.col(f"mean_{p}"), F.lit(0.0)),
        "max_value": F.coalesce(F.col(f"max_{p}"), F.lit(0.0)),
        "daily_limit": F.lit(float(DAILY_LIMITS[p])),
        "exceeds": F.coalesce(F.col(f"mean_{p}"), F.lit(0.0)) > float(DAILY_LIMITS[p]),
    } for p in POLLUTANTS}
    return stats.select(_rows(fields, "pollutant")).select("_r.*")


def completeness(wide: DataFrame) -> DataFrame:
    """Percent of present values per station and pollutant."""
    per_station = wide.groupBy("station_id").agg(
        *[_pct(F.count(p), F.count(F.lit(1))).alias(p) for p in POLLUTANTS])
    return per_station.unpivot(["station_id"], POLLUTANTS, "pollutant", "completeness_pct")


def coverage(wide: DataFrame) -> DataFrame:
    """Rows, dates, inclusive day span and percent present per pollutant, per station."""
    return wide.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.to_date("ts")).alias("date_from"),
        F.max(F.to_date("ts")).alias("date_to"),
        (F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp")))
                 / 86_400_000_000) + 1).alias("days_span"),
        *[F.round(_pct(F.count(p), F.count(F.lit(1))), 1).alias(f"{p}_coverage_pct") for p in POLLUTANTS])


def mean_std_by(wide: DataFrame, key: Column, name: str, cols: list[str] = POLLUTANTS) -> DataFrame:
    """Mean and standard deviation of each column per calendar unit."""
    return wide.groupBy(key.alias(name)).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev(c).alias(f"{c}_std") for c in cols])


def hour_by_day_type(wide: DataFrame, weekend: tuple[int, ...] = (1, 7)) -> DataFrame:
    return wide.where(F.col("pm25").isNotNull()).groupBy(
        F.hour("ts").alias("hour"), day_type(F.dayofweek("ts"), weekend).alias("day_type"),
    ).agg(F.avg("pm25").alias("mean_pm25"))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over rows where both are present, which is
    what ``corr`` uses; pairs without a value are left out. Moments merge, so one small row
    leaves each task."""
    pairs = list(combinations(cols, 2))
    stats = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    names = ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a, b in pairs)
    return stats.selectExpr(f"stack({len(pairs)}, {names}) as (left_col, right_col, r)").where("r is not null and not isnan(r)")


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, std, min, exact quartiles, max and percent null per column, all from one
    table of value counts, so from one pass over the rows."""
    v, n = F.col("_v"), F.col("_n")
    counts = value_counts(melt(df, [], cols), ["column"], "value")
    present = F.when(v.isNotNull(), n)
    means = counts.groupBy("column").agg(
        F.coalesce(F.sum(present), F.lit(0)).alias("n"), (F.sum(v * n) / F.sum(present)).alias("mean"),
        F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.round(_pct(F.sum(F.when(v.isNull(), n).otherwise(0)), F.sum("_n")), 1).alias("null_pct"))
    spread = join_on(counts, means.select("column", "mean"), ["column"]).groupBy("column").agg(
        F.sqrt(F.try_divide(F.sum((v - F.col("mean")) * (v - F.col("mean")) * n), F.sum(present) - 1)).alias("std"))
    quartiles = quantiles_of_counts(counts, ["column"], {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return join_on(join_on(means, spread, ["column"]), quartiles, ["column"])


def seasonal_box(wide: DataFrame, k: float = 1.5) -> DataFrame:
    """Quartiles of PM2.5 per season and the outermost values within the fences, from one
    pass over the readings."""
    seasons = wide.where(F.col("pm25").isNotNull()).select(season(F.month("ts")).alias("season"), "pm25")
    counts = value_counts(seasons, ["season"], "pm25")  # no nulls are left
    q = quantiles_of_counts(counts, ["season"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    inside = F.col("_v").between(F.col("q1") - spread * k, F.col("q3") + spread * k)
    return join_on(counts, q, ["season"]).groupBy("season", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("_n")).otherwise(0)).alias("n_outliers"))


def exceedance_calendar(wide: DataFrame, limit: float = DAILY_LIMITS["pm25"]) -> DataFrame:
    """Daily mean of all stations and whether it exceeds the limit, by year and day of year."""
    daily = wide.groupBy(F.to_date("ts").alias("date")).agg(F.avg("pm25").alias("pm25"))
    return daily.where(F.col("pm25").isNotNull()).select(
        F.year("date").alias("year"), F.dayofyear("date").alias("day_of_year"), "pm25",
        (F.col("pm25") > limit).alias("exceeds"))


def headline(wide: DataFrame, limit: float = DAILY_LIMITS["pm25"]) -> DataFrame:
    """Stations, mean, maximum and the percentage of rows above the limit. Rows without a
    value count as not above."""
    return wide.agg(
        F.countDistinct("station_id").alias("stations"), F.avg("pm25").alias("mean_pm25"),
        F.max("pm25").alias("max_pm25"),
        _pct(F.count_if(F.col("pm25") > limit), F.count(F.lit(1))).alias("exceed_pct"))


def station_vs_limit(wide: DataFrame, limit: float = DAILY_LIMITS["pm25"]) -> DataFrame:
    out = wide.groupBy("station_id").agg(F.avg("pm25").alias("mean_pm25"))
    return out.where(F.col("mean_pm25").isNotNull()).withColumn("above_limit", F.col("mean_pm25") > limit)


def wind_profile(df: DataFrame) -> DataFrame:
    """Mean PM2.5 per wind sector; all eight sectors appear."""
    means = df.where(F.col("pm25").isNotNull() & F.col("wind_direction").isNotNull()).groupBy(
        wind_sector(F.col("wind_direction")).alias("sector")).agg(F.avg("pm25").alias("mean_pm25"))
    return on_domain(means, "sector", list(range(0, 360, 45)))


def with_aqi(wide: DataFrame) -> DataFrame:
    """Sub-indices, overall index and category."""
    return wide.withColumns({
        "aqi_pm25": aqi.index_strict(F.col("pm25")), "aqi_pm10": aqi.index_strict(F.col("pm10"), "pm10"),
    }).withColumn("aqi", aqi.overall(F.col("aqi_pm25"), F.col("aqi_pm10"))).withColumn(
        "aqi_cat", aqi.category(F.col("aqi")))


def station_aqi(wide: DataFrame) -> DataFrame:
    """Mean index per station, over rows that have one."""
    return with_aqi(wide).where(F.col("aqi").isNotNull()).groupBy("station_id").agg(
        F.avg("aqi").alias("mean_aqi"), F.count(F.lit(1)).alias("n"))


def sign_off(df: DataFrame) -> DataFrame:
    """Seven readiness checks with outcome and the number behind each."""
    total = F.count(F.lit(1))
    stats = df.agg(
        F.countDistinct("station_id").alias("stations"), total.alias("total"),
        *[F.count(p).alias(f"n_{p}") for p in POLLUTANTS + WEATHER],
        F.count("population_catchment").alias("n_people"),
        F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp")))
                / 86_400_000_000).alias("days"))

    def present(cols: list[str]) -> Column:
        return sum((F.when(F.col(f"n_{c}") > 0, 1).otherwise(0) for c in cols), F.lit(0)).cast("double")

    worst = F.greatest(*[
        F.when(F.col(f"n_{p}") > 0, _pct(F.col("total") - F.col(f"n_{p}"), F.col("total"))).otherwise(0.0)
        for p in POLLUTANTS])
    checks = [
        ("Multiple stations present", F.col("stations").cast("double"), lambda v: v >= 2),
        ("Multiple pollutants with data", present(POLLUTANTS), lambda v: v >= 3),
        ("Weather enrichment present", present(WEATHER), lambda v: v >= 3),
        ("Population catchment present", F.col("n_people").cast("double"), lambda v: v > 0),
        ("Null rate < 20% (worst pollutant)", worst, lambda v: v < 20),
        ("Date range >= 7 days", F.col("days").cast("double"), lambda v: v >= 7),
        ("Sufficient data volume (>100 rows)", F.col("total").cast("double"), lambda v: v > 100),
    ]
    return stats.select(_rows({n: {"detail": v, "passed": ok(v)} for n, v, ok in checks}, "check_name")).select("_r.*")


def busiest_station(wide: DataFrame) -> DataFrame:
    """The station with the most PM2.5 values; the smaller id wins a tie."""
    counts = wide.where(F.col("pm25").isNotNull()).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "station_id").limit(1)


def station_extent(df: DataFrame) -> DataFrame:
    """Coordinates and first and last time per station."""
    return df.groupBy("station_id").agg(
        F.max("latitude").alias("latitude"), F.max("longitude").alias("longitude"),
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def hourly_city_mean(wide: DataFrame) -> DataFrame:
    return wide.groupBy(hour_of(F.col("ts")).alias("ts")).agg(F.avg("pm25").alias("pm25")).where(
        F.col("pm25").isNotNull())


def daily_station_mean(wide: DataFrame) -> DataFrame:
    return wide.where(F.col("pm25").isNotNull()).groupBy("station_id", F.to_date("ts").alias("date")).agg(
        F.avg("pm25").alias("pm25"))


def weekly_trend(wide: DataFrame, days: int = 7) -> DataFrame:
    """Mean over the last `days` daily means. A group holds one row per day, whatever the
    number of readings."""
    w = Window.partitionBy("station_id").orderBy("date").rowsBetween(-(days - 1), 0)
    return daily_station_mean(wide).withColumn("rolling_mean", F.avg("pm25").over(w))


def flagged_share(df: DataFrame, flags: list[str]) -> DataFrame:
    """Percent of rows that carry each provenance flag."""
    return df.agg(*[(F.avg(F.col(f).cast("int")) * 100).alias(f"{f}_pct") for f in flags])
