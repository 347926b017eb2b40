"""Next-hour forecasting: features, split, baselines, models and day-ahead recursion."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions.aqi import index_ceiling
from hazegrid.functions.atmosphere import boundary_layer_height, clip
from hazegrid.functions.calendar import by_season, hour_of, with_calendar
from hazegrid.operators.fitted import fit_linear, predictor, score_linear, with_row
from hazegrid.operators.lookup import join_on
from hazegrid.operators.ordering import over_rows, with_position
from hazegrid.schema import SEASONS
from hazegrid.session import cut_lineage

FEATURES = ["pm25_lag1", "pm25_lag24", "pm25_roll24", "hour", "dow", "month", "season_code"]
WEATHER_FEATURES = ["temperature", "humidity", "wind_speed", "blh_m"]
BASELINE = "Persistence (naive)"
# Stations of a forecast that one task takes. Their states are few bytes and much work, so sizes in bytes would put all into one task.
STATIONS = 100


# ---- features ---------------------------------------------------------------------------

def lag_features(df: DataFrame, order: list[str] = ["ts"], past_only: bool = False) -> DataFrame:
    """Lags 1 and 24, a 24-row mean and the next value per station, counted in rows.

    The mean includes the current row, or with `past_only` the 24 rows before it when at
    least 6 of them have values.
    """
    def columns(w):
        if past_only:
            past = w.rowsBetween(-24, -1)
            roll = F.when(F.count("pm25").over(past) >= 6, F.avg("pm25").over(past))
        else:
            roll = F.avg("pm25").over(w.rowsBetween(-23, 0))
        return {
            "pm25_lag1": F.lag("pm25", 1).over(w), "pm25_lag24": F.lag("pm25", 24).over(w),
            "pm25_roll24": roll, "target": F.lead("pm25", 1).over(w),
        }

    return over_rows(df, ["station_id"], [F.col(c) for c in order], columns, before=24, after=1)


def feature_frame(df: DataFrame, weather: bool = True, past_only: bool = False) -> DataFrame:
    """Model input: rows with PM2.5, lags, calendar and weather; rows with any null are dropped."""
    lagged = with_calendar(lag_features(df.where(F.col("pm25").isNotNull()), past_only=past_only))
    cols = list(FEATURES)
    if weather:
        lagged = lagged.withColumn("blh_m", boundary_layer_height(
            F.col("hour"), F.col("month"), F.col("temperature"), F.col("wind_speed")))
        cols += WEATHER_FEATURES
    return lagged.select("station_id", "ts", "target", *cols).na.drop()


def chronological_split(features: DataFrame, share: float = 0.8) -> DataFrame:
    """Add ``is_train``: the first `share` of each station's rows by time."""
    placed = with_position(features, ["station_id"], [F.col("ts")], "_pos", "_total")
    return placed.withColumn("is_train", F.col("_pos") <= F.floor(F.col("_total") * share)).drop("_pos", "_total")


def training_table(df: DataFrame, weather: bool = True, share: float = 0.8) -> DataFrame:
    """Features with the training flag, written to the shared folder, because every fit reads them many times. So are the rows with a value
    before, because sorting them into ranges reads them twice, and `df` is often a join. Runs jobs."""
    known = cut_lineage(df.where(F.col("pm25").isNotNull()), "known")
    return cut_lineage(chronological_split(feature_frame(known, weather), share), "split")


# ---- evaluation -------------------------------------------------------------------------

def regression_metrics(preds: DataFrame, keys: list[str] = [], label: str = "target") -> DataFrame:
    """Root mean squared error, mean absolute error and R2 in one pass; R2 is null when the
    label does not vary."""
    e = F.col("prediction") - F.col(label)
    return preds.groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(label) * F.count(label))).alias("r2"),
        F.count(F.lit(1)).alias("n"))


def persistence(split: DataFrame, steps: int = 2) -> DataFrame:
    """Predict the next value by an earlier one: the last reading but one (``steps=2``, the
    usual baseline here), which the features hold as lag 1."""
    if steps != 2:
        raise ValueError("the feature frame holds the value two steps before the target")
    return split.where(~F.col("is_train")).select(
        "station_id", "ts", "target", F.col("pm25_lag1").alias("prediction"))


def skill(metrics: DataFrame) -> DataFrame:
    """Percent by which each model's error lies below that of the baseline."""
    naive = metrics.where(F.col("model") == BASELINE).agg(F.max("rmse").alias("_naive"))
    return join_on(metrics, naive, []).withColumn(
        "skill_pct", F.try_divide((F.col("_naive") - F.col("rmse")) * 100, F.col("_naive"))).drop("_naive")


# ---- models -----------------------------------------------------------------------------

def candidates() -> dict:
    """Estimators to compare; any Spark regressor with a features column fits in."""
    return {
        "LinearRegression": LinearRegression(featuresCol="features", labelCol="target", maxIter=200),
        "RandomForest": RandomForestRegressor(
            featuresCol="features", labelCol="target", numTrees=100, maxDepth=8, seed=42),
        "GBT": GBTRegressor(
            featuresCol="features", labelCol="target", maxIter=80, maxDepth=5, stepSize=0.1,
            subsamplingRate=0.8, seed=42),
    }


def assembler(cols: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip")


def feature_columns(split: DataFrame) -> list[str]:
    return [c for c in FEATURES + WEATHER_FEATURES if c in split.columns]


def fit(split: DataFrame, estimator) -> PipelineModel:
    """Fit on the training rows. Runs Spark jobs."""
    train = split.where("is_train")
    # Sampling trees see the rows in the order of the stored table.
    return Pipeline(stages=[assembler(feature_columns(split)), estimator]).fit(train)


def score(model: PipelineModel, split: DataFrame) -> DataFrame:
    """Time, target and prediction of the rows held out."""
    return model.transform(split.where(~F.col("is_train"))).select("station_id", "ts", "target", "prediction")


def fit_line(split: DataFrame) -> DataFrame:
    """Least squares on the training rows, from one aggregation; a row of `fit_linear`. Lazy."""
    return fit_linear(split.where("is_train"), feature_columns(split))


def score_line(model: DataFrame, split: DataFrame) -> DataFrame:
    """Time, target and prediction of the rows held out, with a model of `fit_line`."""
    return score_linear(split.where(~F.col("is_train")), model, feature_columns(split)).select("station_id", "ts", "target", "prediction")


def compare(split: DataFrame, estimators: dict | None = None) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Fit every estimator and table its errors next to the baseline's, best first.

    `split` should be a stored table such as `training_table` returns, because every fit
    reads it many times. Returns the table and the fitted models; the baseline has no model.
    """
    data = split
    models = {name: fit(data, est) for name, est in (estimators or candidates()).items()}
    preds = persistence(data).withColumn("model", F.lit(BASELINE))
    for name, model in models.items():
        preds = preds.unionByName(score(model, data).withColumn("model", F.lit(name)))
    table = skill(regression_metrics(preds, ["model"]))
    return table.orderBy("rmse", "model"), models


def winner(table: DataFrame) -> str:
    """Name of the model with the smallest error; one row reaches the driver."""
    return table.orderBy("rmse", "model").first()["model"]


def feature_importance(model: PipelineModel) -> DataFrame | None:
    """Importance per feature of a tree model; None for a model that has none."""
    cols, last = model.stages[0].getInputCols(), model.stages[-1]
    if not hasattr(last, "featureImportances"):
        return None
    from pyspark.sql import SparkSession

    rows = [(c, float(v)) for c, v in zip(cols, last.featureImportances.toArray())]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


# ---- latest state and day-ahead recursion -----------------------------------------------

def live_vector(spine: DataFrame) -> DataFrame:
    """Lag 1, lag 24 and the 24-hour mean at the last hour of each station's spine, after
    carrying values forward. A spine holds a fixed number of hours per station."""
    w = Window.partitionBy("station_id").orderBy("ts")
    carried = spine.withColumn("pm25", F.last("pm25", ignorenulls=True).over(w))
    place = carried.withColumn("_back", F.row_number().over(Window.partitionBy("station_id").orderBy(F.desc("ts"))))
    return place.groupBy("station_id").agg(
        F.max("ts").alias("ts"),
        F.max(F.when(F.col("_back") == 1, F.col("pm25"))).alias("pm25_lag1"),
        F.max(F.when(F.col("_back") == 24, F.col("pm25"))).alias("pm25_lag24"),
        F.avg(F.when(F.col("_back") <= 24, F.col("pm25"))).alias("pm25_roll24"))


def cold_start(df: DataFrame, pm25: str = "pm25", hour: str = "hour") -> DataFrame:
    """Lags guessed from a single reading."""
    swing = F.lit(1.05) + F.sin(F.col(hour) * F.lit(math.pi) / 12) * 0.05
    lag24 = clip(F.col(pm25) * swing, 10.0)
    return df.withColumns({
        "pm25_lag1": F.col(pm25), "pm25_lag24": lag24, "pm25_roll24": (F.col(pm25) + lag24) / 2})


def next_hour_formula(lag1: Column, roll24: Column, blh: Column) -> Column:
    """Next hour without a model: persistence plus trapping under a low boundary layer."""
    trapping = F.sqrt(F.lit(850.0) / clip(blh, 150.0))
    return clip(F.round(lag1 * 0.78 + roll24 * 0.15 + trapping * 12.0, 1), 5.0)


def hourly_formula(lag: Column, blh: Column) -> Column:
    """One hour of the recursion without a model."""
    return clip(F.round(lag * 0.85 + F.lit(800.0) / blh * 15.0, 1), 6.0)


def horizon(start: Column, hours: int) -> Column:
    return F.sequence(start, start + F.expr(f"interval {hours - 1} hours"), F.expr("interval 1 hour"))


def _coming_hours(state: DataFrame, weather: DataFrame | None, hours: int, names: list[str]) -> DataFrame:
    """`state` with `_hours`, an array of (ts, weather) for the coming hours. Hours that `weather` (station_id, ts_hour and
    the columns `names`) does not know keep the state's own weather. A station has `hours` entries."""
    if weather is None:
        return state.withColumn("_hours", F.transform(horizon(F.col("ts"), hours), lambda t: F.struct(t.alias("ts"), *[F.col(n) for n in names])))
    ahead = state.select("station_id", *[F.col(n).alias(f"_{n}") for n in names], F.posexplode(horizon(F.col("ts"), hours)).alias("_i", "_t"))
    known = weather.select("station_id", "ts_hour", *names)
    laid = join_on(ahead.withColumn("ts_hour", hour_of(F.col("_t"))), known, ["station_id", "ts_hour"])
    entry = F.struct("_i", F.col("_t").alias("ts"), *[F.coalesce(n, f"_{n}").alias(n) for n in names])
    rows = laid.groupBy("station_id").agg(F.sort_array(F.collect_list(entry)).alias("_hours"))
    return join_on(state, rows, ["station_id"])


def day_ahead_formula(state: DataFrame, weather: DataFrame | None = None, hours: int = 24) -> DataFrame:
    """Recursive forecast per station as one fold over the coming hours and their weather, with the index of each step.

    `state` has station_id, ts (first hour), pm25 (start value), temperature and wind_speed.
    """
    coming = _coming_hours(state, weather, hours, ["temperature", "wind_speed"])
    steps = F.transform("_hours", lambda h: F.struct(h["ts"].alias("ts"), boundary_layer_height(
        F.hour(h["ts"]), F.month(h["ts"]), h["temperature"], h["wind_speed"]).alias("blh")))
    empty = F.array().cast("array<double>")
    folded = coming.withColumn("_steps", steps).withColumn("_path", F.aggregate(
        F.col("_steps"), empty,
        lambda acc, s: F.array_append(acc, hourly_formula(
            F.when(F.size(acc) == 0, F.col("pm25")).otherwise(F.try_element_at(acc, F.lit(-1))), s["blh"]))))
    return folded.select("station_id", F.posexplode(F.arrays_zip("_steps", "_path")).alias("step", "_s")).select(
        "station_id", F.col("step").cast("int").alias("step"), F.col("_s._steps.ts").alias("ts"),
        F.col("_s._steps.blh").alias("blh_m"), F.col("_s._path").alias("pm25"), index_ceiling(F.col("_s._path")).alias("aqi"))


def day_ahead_model(
    state: DataFrame, model: PipelineModel | DataFrame, weather: DataFrame | None = None, hours: int = 24, features: list[str] | None = None,
) -> DataFrame:
    """Recursive forecast with a fitted model, all stations at once, with the index of each step.

    `state` has station_id, ts, the three lag columns and the weather features, which `weather` replaces hour by hour where it
    knows them. The model is evaluated inside one fold over the coming hours, so a station's path is made in one stage, in one row.
    A row of `fit_linear` needs its `features` named. The states are written to the shared folder and counted, because a fold over trees is long
    and the rows are small: a task makes the paths of about `STATIONS` stations. Runs these jobs.
    """
    names = ["temperature", "humidity", "wind_speed"]
    state = cut_lineage(state, "state")
    parts = math.ceil(state.count() / STATIONS)
    row, make = predictor(model, features)

    def known(h: Column) -> dict[str, Column]:
        month = F.month(h["ts"])
        return {
            "hour": F.hour(h["ts"]), "dow": F.dayofweek(h["ts"]), "month": month,
            "season_code": by_season(month, {s: i for i, s in enumerate(SEASONS)}),
            "blh_m": boundary_layer_height(F.hour(h["ts"]), month, h["temperature"], h["wind_speed"]), **{n: h[n] for n in names}}

    steps = _coming_hours(state, weather, hours, names).withColumn(
        "_steps", F.transform("_hours", lambda h: F.struct(*[v.alias(n) for n, v in known(h).items()]))).drop("_hours", *names)
    start = F.struct(F.col("pm25_lag1").cast("double").alias("lag1"), F.col("pm25_roll24").cast("double").alias("roll"),
                     F.array().cast("array<double>").alias("path"))

    def step(acc: Column, h: Column) -> Column:
        x = {n: h[n] for n in ["hour", "dow", "month", "season_code", "blh_m", *names]}
        x |= {"pm25_lag1": acc["lag1"], "pm25_lag24": F.col("pm25_lag24"), "pm25_roll24": acc["roll"]}
        # the prediction is bound once, as the one element of an array, however often it is used
        once = F.array(clip(F.round(predict(x), 1), 6.0))
        return F.transform(once, lambda p: F.struct(
            p.alias("lag1"), (acc["roll"] * 0.95 + p * 0.05).alias("roll"), F.array_append(acc["path"], p).alias("path")))[0]

    ready = with_row(steps.repartition(parts, "station_id") if parts > 1 else steps, row, "_model")
    predict = make(F.col("_model"))
    path = F.aggregate("_steps", start, step, lambda acc: acc["path"])
    return ready.select("station_id", "ts", F.posexplode(path).alias("step", "pm25")).select(
        "station_id", "step", F.expr("ts + make_dt_interval(0, step)").alias("ts"), "pm25", index_ceiling(F.col("pm25")).alias("aqi"))


def peak(forecast: DataFrame) -> DataFrame:
    """Highest forecast value per station and its first hour."""
    return forecast.groupBy("station_id").agg(
        F.max(F.struct(F.col("pm25"), (-F.col("step")).alias("back"))).alias("_m")).select(
        "station_id", F.col("_m.pm25").alias("peak_pm25"), (-F.col("_m.back")).alias("peak_step"))


# ---- scenarios, plots and samples -------------------------------------------------------

def what_if(df: DataFrame, scenarios: list[tuple]) -> DataFrame:
    """Repeat every row for each (name, temperature, humidity, wind_speed) of a fixed list,
    with the mixing height that follows."""
    options = F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(float(t)).alias("temperature"),
                 F.lit(float(h)).alias("humidity"), F.lit(float(w)).alias("wind_speed"))
        for n, t, h, w in scenarios])
    base = df.drop("temperature", "humidity", "wind_speed", "blh_m")
    out = base.withColumn("_o", F.explode(options)).select("*", "_o.*").drop("_o")
    return out.withColumn("blh_m", boundary_layer_height(
        F.hour("ts"), F.month("ts"), F.col("temperature"), F.col("wind_speed")))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first `n` rows in the given order."""
    return df.orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, key: list[str], share: float, seed: int = 42) -> DataFrame:
    """About `share` of the rows, by a hash of their keys: the same rows whenever keys and seed are the same, without
    a sort or a shuffle. Null keys count as empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    part = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.where(part < share)


def bottom_sample(df: DataFrame, key: list[str], n: int = 3_000, seed: int = 42) -> DataFrame:
    """At most `n` rows, all if there are fewer: those with the least hashes of their keys, ties by all their values. The same rows however
    `df` is partitioned. Every task keeps its `n` least rows, and only those are merged. Null keys count as empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return df.withColumn("_hash", F.md5(text)).orderBy("_hash", *df.columns).limit(n).drop("_hash")
