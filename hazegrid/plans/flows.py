"""The jobs of a deployment: build the store, derive the result tables, train the forecast, serve it, follow live readings.

    python -m hazegrid.plans.flows build --stations S --measurements M --weather W --store OUT --from DAY --to DAY [--cells CELLS]
    python -m hazegrid.plans.flows build-long --stations S --measurements M --store OUT --results DIR --from DAY --to DAY
    python -m hazegrid.plans.flows analyse --store OUT --results DIR
    python -m hazegrid.plans.flows train --store OUT --results DIR
    python -m hazegrid.plans.flows serve --store OUT --results DIR [--weather W]
    python -m hazegrid.plans.flows live --measurements M --results DIR [--delay "3 hours"]
"""

from __future__ import annotations

import argparse

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.functions import aqi
from hazegrid.functions.atmosphere import boundary_layer_height, clip
from hazegrid.functions.calendar import with_calendar
from hazegrid.functions.signatures import with_source_scores
from hazegrid.operators import cleaning, fitted, forecast, health, joins, profile, signatures, spatial
from hazegrid.operators.lookup import join_on
from hazegrid.schema import AREA_DENSITY, CLEANED, KNOWN_CATCHMENTS, POLLUTANTS, WEATHER
from hazegrid.session import SETTINGS, cut_lineage
from hazegrid.sources import landed, tables
from hazegrid.streaming import live


def build_store(
    spark: SparkSession, stations: str, measurements: str, weather: str, store: str, first_day: str, last_day: str,
    population: DataFrame | None = None, box: dict[str, float] | None = None, cells: DataFrame | None = None, radius_km: float = 3.0,
) -> None:
    """Landed files to the cleaned store, partitioned by station, year and month.

    `population` has station_id and population_catchment. Without it the catchments are the sums of the population `cells` (cell_id, lat, lon, pop)
    within `radius_km` of a station in latitude and longitude, and without cells they come from the station names.
    """
    places = landed.stations(landed.read_json(spark, stations, landed.STATION_JSON), box).drop("sensors")
    readings = landed.within_days(
        landed.measurements(landed.read_json(spark, measurements, landed.MEASUREMENT_JSON)), first_day, last_day)
    wide = cleaning.widen(cleaning.standardise(readings), ["ts", "station_id"])
    people = population
    if people is None:
        people = (joins.catchment_from_name(places, AREA_DENSITY, KNOWN_CATCHMENTS) if cells is None
                  else spatial.population_in_square(places, cells, radius_km))
    hourly = landed.weather(landed.read_json(spark, weather, landed.WEATHER_JSON))
    full = cut_lineage(joins.with_population(joins.with_weather(joins.with_station(wide, places), hourly), people), "full")
    tables.write_by_station_month(cleaning.clean_store(full, POLLUTANTS + WEATHER), store)


def build_long_store(spark: SparkSession, stations: str, measurements: str, store: str, results: str, first_day: str, last_day: str,
                     box: dict[str, float] | None = None) -> None:
    """Landed files to a store of one row per station, parameter and time, partitioned by station, year and month: the value as measured, is_outlier,
    and value_clean, where outliers and missing values are filled from the three readings before and then from the day's median.

    Of several readings at one time the smallest value stays, a missing one only if there is no other. The outliers per parameter, counted before
    filling, go to outlier_summary below `results`, and the hourly table of filled values, one column per pollutant, to hourly."""
    places = landed.stations(landed.read_json(spark, stations, landed.STATION_JSON), box).drop("sensors")
    readings = cleaning.standardise(landed.within_days(
        landed.measurements(landed.read_json(spark, measurements, landed.MEASUREMENT_JSON)), first_day, last_day))
    once = cut_lineage(cleaning.deduplicate(readings, ["ts", "station_id", "parameter"], ["value"]), "once")
    tables.write_csv(cleaning.outlier_summary(cleaning.flag_outliers(once)).orderBy("parameter"), f"{results}/outlier_summary")
    filled = cut_lineage(cleaning.fill_gaps_long(once), "filled")
    tables.write_by_station_month(joins.with_station(filled, places), store)
    tables.write_parquet(cleaning.hourly_wide(filled.withColumn("value", F.col("value_clean"))), f"{results}/hourly")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The store with its declared types; the float32 pollutants are widened for arithmetic."""
    df = tables.read_parquet(spark, store, CLEANED)
    return df.withColumns({p: F.col(p).cast("double") for p in POLLUTANTS})


def analyse(spark: SparkSession, store: str, results: str) -> None:
    """Every result table as CSV below `results`, and the fact table for reports as Parquet."""
    df = read_store(spark, store)
    scores = cut_lineage(signatures.by_station_season(with_source_scores(with_calendar(df))), "scores")
    means = cut_lineage(health.station_means(df, health.STATION_KEYS), "means")
    burden = health.burden_table(means)
    ranking = cut_lineage(health.impact_ranking(df), "ranking")
    month = df.withColumn("month", F.month("ts"))
    outputs = {
        "source_scores_by_station_season": scores,
        "source_profile_by_season": signatures.season_profile(scores).orderBy("ordinal"),
        "source_shares_by_station": signatures.station_shares(scores),
        "exposure_by_station": health.exposure_table(df, health.STATION_KEYS).orderBy(F.desc("mean_exposure_score")),
        "exposure_by_station_month": health.exposure_table(month, ["station_id", "station_name", "month"]).orderBy(
            "station_id", "month"),
        "health_burden_table": burden,
        "health_burden_by_crf": health.burden_by_crf(burden),
        "health_burden_range": health.burden_range(burden),
        "health_burden_short_term_pm10": health.period_excess(df).orderBy(F.desc("period_excess_deaths_pm10")),
        "seasonal_city_burden": health.seasonal_city_burden(df).orderBy("ordinal"),
        "health_ranking_summary": ranking.orderBy("rank", "station_id", "season"),
        "rank_divergence": health.rank_divergence(ranking).orderBy("health_rank"),
        "qc_report": profile.quality_report(df),
        "station_coverage_report": profile.coverage(df).orderBy("station_id"),
        "summary_statistics": profile.describe(df, POLLUTANTS + WEATHER + ["population_catchment"]),
        "correlations": profile.correlations(df, POLLUTANTS + WEATHER),
        "monthly_profile": profile.mean_std_by(df, F.month("ts"), "month").orderBy("month"),
        "diurnal_profile": profile.mean_std_by(df, F.hour("ts"), "hour").orderBy("hour"),
        "hour_by_day_type": profile.hour_by_day_type(df).orderBy("hour", "day_type"),
        "seasonal_box": profile.seasonal_box(df).orderBy("season"),
        "wind_profile": profile.wind_profile(df).orderBy("ordinal"),
        "exceedance_calendar": profile.exceedance_calendar(df).orderBy("year", "day_of_year"),
        "weekly_trend": profile.weekly_trend(df),
        "station_aqi": profile.station_aqi(df).orderBy("station_id"),
        "station_vs_limit": profile.station_vs_limit(df).orderBy("station_id"),
        "sign_off": profile.sign_off(df),
    }
    for name, table in outputs.items():
        tables.write_csv(table, f"{results}/{name}")
    tables.write_parquet(tables.export_view(df), f"{results}/enriched_data")


def train(spark: SparkSession, store: str, results: str, estimators: dict | None = None) -> str:
    """Compare the models, store the winner with its predictions and facts; returns its name."""
    data = forecast.training_table(read_store(spark, store))
    table, models = forecast.compare(data, estimators)
    tables.write_csv(table, f"{results}/model_comparison")
    best = forecast.winner(table)
    if best in models:
        model = models[best]
        forecast.save_model(model, f"{results}/model")
        importance = forecast.feature_importance(model)
        if importance is not None:
            tables.write_csv(importance, f"{results}/feature_importance")
        predictions = forecast.score(model, data)
    else:
        predictions = forecast.persistence(data)
    tables.write_csv(predictions.orderBy("ts", "station_id"), f"{results}/test_predictions")
    errors = table.where(F.col("model") == best).first()
    sizes = data.agg(F.count_if("is_train").alias("k"), F.count(F.lit(1)).alias("n")).first()
    tables.write_metadata(
        spark, f"{results}/model_metadata", model_name=best, features=forecast.feature_columns(data),
        rmse=errors.rmse, mae=errors.mae, r2=errors.r2, training_rows=sizes.k, test_rows=sizes.n - sizes.k)
    return best


def live_state(df: DataFrame, hours: int = 72) -> DataFrame:
    """station_id, ts (last hour), pm25_lag1, pm25_lag24, pm25_roll24 and the last known weather of each station, over its last `hours` hours with
    values carried forward. Stations without a PM2.5 value, or without weather in those hours, are left out."""
    names = ["temperature", "humidity", "wind_speed"]
    spine = joins.on_spine(df.select("station_id", "ts", "pm25", *names), hours, carry=("pm25",))
    last = spine.groupBy("station_id").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("ts"))).alias(n) for n in names])
    return join_on(forecast.live_vector(spine.select("station_id", "ts", "pm25")), last, ["station_id"]).na.drop()


def next_hour(state: DataFrame, model: PipelineModel | None) -> DataFrame:
    """`state` with `next_pm25`: the model's prediction from the last hour (5 at least), or the formula's without a model."""
    known = with_calendar(state).withColumn("blh_m", boundary_layer_height(F.hour("ts"), F.month("ts"), F.col("temperature"), F.col("wind_speed")))
    if model is None:
        value = forecast.next_hour_formula(F.col("pm25_lag1"), F.col("pm25_roll24"), F.col("blh_m"))
        return known.withColumn("next_pm25", value).select(*state.columns, "next_pm25")
    row, make = fitted.predictor(model)
    ready = fitted.with_row(known, row, "_model")
    predicted = make(F.col("_model"))({c: F.col(c) for c in forecast.FEATURES + forecast.WEATHER_FEATURES})
    return ready.withColumn("next_pm25", clip(F.round(predicted, 1), 5.0)).select(*state.columns, "next_pm25")


def stored_model(spark: SparkSession, results: str) -> PipelineModel | None:
    """The model that `train` stored, or None where the baseline won."""
    best = spark.read.json(f"{results}/model_metadata").first()["model_name"]
    return None if best == forecast.BASELINE else PipelineModel.load(f"{results}/model")


def serve(spark: SparkSession, store: str, results: str, weather: str | None = None) -> None:
    """Forecasts of every station from the end of its readings: next_hour with index and advice, day_ahead hour by hour, and its peak.

    They come from the stored model, or from the formulas where the baseline won. The day starts from the next hour's value, as
    its first lag. `weather` names landed weather files that cover coming hours; hours they do not know have the station's last weather."""
    model = stored_model(spark, results)
    hourly = None if weather is None else landed.weather(landed.read_json(spark, weather, landed.WEATHER_JSON))
    state = cut_lineage(next_hour(live_state(read_store(spark, store)), model), "state")
    index = aqi.index_ceiling(F.col("next_pm25"))
    commuter, mask, ventilation = aqi.advice(index)
    tables.write_csv(state.select(
        "station_id", (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), F.col("pm25_lag1").alias("last_pm25"), "next_pm25", index.alias("aqi"),
        aqi.category(index).alias("aqi_cat"), commuter.alias("commuter"), mask.alias("mask"), ventilation.alias("ventilation")), f"{results}/next_hour")
    if model is None:
        start = state.select("station_id", "ts", F.col("next_pm25").alias("pm25"), "temperature", "wind_speed")
        path = forecast.day_ahead_formula(start, hourly).drop("blh_m")
    else:
        path = forecast.day_ahead_model(state.withColumn("pm25_lag1", F.col("next_pm25")).drop("next_pm25"), model, hourly)
    path = cut_lineage(path, "day_ahead")
    tables.write_csv(path.orderBy("station_id", "step"), f"{results}/day_ahead")
    tables.write_csv(forecast.peak(path), f"{results}/day_ahead_peak")


def follow(spark: SparkSession, measurements: str, results: str, delay: str = "3 hours") -> None:
    """Take up the measurement files that have landed in a folder since the last call, as streams whose state and rows stay below `results`:
    readings (each once), latest, hourly, daily and hourly_aqi; the newest value per station with index and advice is written as CSV latest_aqi.

    Readings are the same when station, parameter, time, value and unit are. One that comes more than `delay` after the newest is left out
    of all but what it was counted in before. An hour is written once `delay` has passed since its end, so every row is final."""
    arriving = spark.readStream.schema(landed.MEASUREMENT_JSON).options(**tables.JSON_TIMES).json(measurements)
    readings = live.timed(cleaning.standardise(landed.measurements(arriving))).where("value is not null")
    once = live.run_available(live.without_repeats(readings, ["station_id", "parameter", "ts", "value", "unit"], delay), f"{results}/readings")

    def unique() -> DataFrame:
        return spark.readStream.schema(once.schema).parquet(f"{results}/readings/rows")

    live.run_available(live.hourly_means(unique(), delay), f"{results}/hourly")
    live.run_available(live.daily_means_hourly(unique(), delay), f"{results}/daily")
    live.run_available(live.hourly_aqi(unique(), delay), f"{results}/hourly_aqi")
    latest = live.run_updates(live.latest_valid(unique()), f"{results}/latest", ["station_id"])
    index = aqi.index_live(F.col("value"))
    commuter, mask, ventilation = aqi.advice(index)
    tables.write_csv(latest.select(
        "station_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("pm25"), index.alias("aqi"), aqi.category(index).alias("aqi_cat"),
        commuter.alias("commuter"), mask.alias("mask"), ventilation.alias("ventilation")), f"{results}/latest_aqi")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)
    build = jobs.add_parser("build")
    for name in ("stations", "measurements", "weather", "store", "from", "to"):
        build.add_argument(f"--{name}", required=True)
    build.add_argument("--cells", help="Parquet with cell_id, lat, lon, pop")
    build.add_argument("--radius-km", type=float, default=3.0)
    for name in ("analyse", "train", "serve"):
        job = jobs.add_parser(name)
        job.add_argument("--store", required=True)
        job.add_argument("--results", required=True)
        if name == "serve":
            job.add_argument("--weather", help="landed weather of coming hours")
    long = jobs.add_parser("build-long")
    for name in ("stations", "measurements", "store", "results", "from", "to"):
        long.add_argument(f"--{name}", required=True)
    job = jobs.add_parser("live")
    job.add_argument("--measurements", required=True, help="folder of landed measurement files")
    job.add_argument("--results", required=True)
    job.add_argument("--delay", default="3 hours")
    args = vars(parser.parse_args())
    builder = SparkSession.builder.appName(f"hazegrid {args['job']}")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if args["job"] == "build":
        cells = None if args["cells"] is None else spark.read.parquet(args["cells"])
        build_store(spark, args["stations"], args["measurements"], args["weather"], args["store"], args["from"], args["to"],
                    cells=cells, radius_km=args["radius_km"])
    elif args["job"] == "serve":
        serve(spark, args["store"], args["results"], args["weather"])
    elif args["job"] == "build-long":
        build_long_store(spark, args["stations"], args["measurements"], args["store"], args["results"], args["from"], args["to"])
    elif args["job"] == "live":
        follow(spark, args["measurements"], args["results"], args["delay"])
    else:
        {"analyse": analyse, "train": train}[args["job"]](spark, args["store"], args["results"])


if __name__ == "__main__":
    main()
