"""Models. Least squares has SQL by the same normal equations; iterative fits have none, and tests compare them with known answers."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hazegrid.operators import fitted, forecast
from hazegrid.plans.catalog.expressions import CEIL_SQL
from hazegrid.plans.catalog.registry import query
from hazegrid.plans.catalog.windows import BLH, FEATURES_SQL
from hazegrid.plans.tables import sql
from hazegrid.session import cut_lineage, scratch_path


def split_of(t):
    """Features of every station with the training flag, written once."""
    return forecast.training_table(t.enriched)


def predictions(t, name: str):
    data = split_of(t)
    return forecast.score(forecast.fit(data, forecast.candidates()[name]), data)


@query("m02_vector_assembly", sql("""
  with k as (select station_id, ts, pm25, temperature, wind_speed from enriched
    where pm25 is not null and temperature is not null and wind_speed is not null)
  select station_id, ts, 0::bigint as place, pm25 as value from k union all select station_id, ts, 1, temperature from k
  union all select station_id, ts, 2, wind_speed from k""", "enriched"), rounds={"value": 6})
def m02(t):
    features = forecast.assembler(["pm25", "temperature", "wind_speed"]).transform(t.enriched)
    return features.select("station_id", "ts", F.posexplode(vector_to_array("features")).alias("place", "value"))


# The same normal equations for DuckDB: covariances of the training rows, standardised, and Gauss-Jordan elimination as a recursion.
COLS = forecast.FEATURES + forecast.WEATHER_FEATURES
K = len(COLS)
LINE_SQL = f"""with recursive rows as ({FEATURES_SQL}),
  s as (select *, [{', '.join(f'{x}::double' for x in [*COLS, 'target'])}] as v,
    row_number() over (partition by station_id order by ts) <= floor(count(*) over (partition by station_id) * 0.8::double) as is_train from rows),
  cov as (select i, j, covar_pop(v[i], v[j]) as c, avg(v[i]) as mean from s, range(1, {K + 2}) a(i), range(1, {K + 2}) b(j) where is_train group by i, j),
  sd as (select i, mean, case when c > 1e-12 * mean * mean then sqrt(c) else 0 end as sd from cov where i = j),
  cor as (select cov.i, cov.j, case when cov.i = cov.j then (a.sd > 0)::int::double else coalesce(c / nullif(a.sd * b.sd, 0), 0) end as r
    from cov join sd a on a.i = cov.i join sd b on b.i = cov.j),
  lines as (select i, list(r order by j) as r from cor where i <= {K} group by i),
  g(k, m) as (
    select 1, list(r order by i) from lines
    union all
    select k + 1, list_transform(m, lambda r, i: case when i = k then p else list_transform(r, lambda x, j: x - r[k] * p[j]) end)
    from (select k, m, list_transform(m[k], lambda x: case when m[k][k] > 1e-9 then x / m[k][k] else 0 end) as p from g where k <= {K})),
  w as (select i, coalesce(m[i][{K + 1}] * (select sd from sd where i = {K + 1}) / nullif(sd, 0), 0) as w, mean from g, sd where k = {K + 1} and i <= {K}),
  model as (select list(w order by i) as w, (select mean from sd where i = {K + 1}) - sum(w * mean) as b from w),
  scored as (select s.*, b + list_dot_product(w, v[1:{K}]) as prediction from s, model)
  """
LINE = {"target": 6, "prediction": 6}
HELD_OUT = "select station_id, ts, target, prediction from scored where not is_train"


@query("m03_linear_regression", sql(LINE_SQL + HELD_OUT, "wide", "weather"), rounds=LINE)
def m03(t):
    data = split_of(t)
    return forecast.score_line(forecast.fit_line(data), data)


@query("m03_linear_estimator")
def m03_estimator(t):
    return predictions(t, "LinearRegression")


def tree_predictions(t, name: str):
    """Predictions from the stored node table of the fitted ensemble."""
    data = split_of(t)
    model = forecast.fit(data, forecast.candidates()[name])
    nodes = fitted.node_table(model)
    held_out = data.where(~F.col("is_train"))
    return fitted.score_forest(held_out, nodes, forecast.feature_columns(data), model.stages[-1].getMaxDepth()).select(
        "station_id", "ts", "target", "prediction")


@query("m04_random_forest")
def m04(t):
    return tree_predictions(t, "RandomForest")


@query("m05_gradient_boosting")
def m05(t):
    return tree_predictions(t, "GBT")


@query("m07_model_comparison")
def m07(t):
    return forecast.compare(split_of(t))[0]


@query("m08_feature_importance")
def m08(t):
    return fitted.tree_importance(fitted.node_table(forecast.fit(split_of(t), forecast.candidates()["RandomForest"])))


BEST_SQL = """, errors as (select sqrt(avg((prediction - target) ** 2)) as line, sqrt(avg((pm25_lag1 - target) ** 2)) as naive from scored where not is_train)
  select station_id, ts, target, case when line <= naive then prediction else pm25_lag1 end as prediction from scored, errors where not is_train"""


@query("m09_batch_scoring", sql(LINE_SQL + BEST_SQL, "wide", "weather"), rounds=LINE)
def m09(t):
    data = split_of(t)
    # The baseline may win; it needs no model.
    model = forecast.fit_line(data)
    preds = forecast.score_line(model, data).withColumn("model", F.lit("LinearRegression")).unionByName(
        forecast.persistence(data).withColumn("model", F.lit(forecast.BASELINE)))
    best = forecast.winner(forecast.skill(forecast.regression_metrics(preds, ["model"])))
    return preds.where(F.col("model") == best).drop("model")


AHEAD_SQL = f""", st as (select station_id, max(ts) as ts, max_by(pm25_lag1, ts) as pm25_lag1, max_by(pm25_lag24, ts) as pm25_lag24,
    max_by(pm25_roll24, ts) as pm25_roll24, max_by(temperature, ts) as temperature, max_by(humidity, ts) as humidity,
    max_by(wind_speed, ts) as wind_speed from s group by 1),
  h as (select *, {BLH} as blh_m from (
    select st.station_id, k as step, st.ts + to_hours(k::int) as ts, 360.0::double as base, pm25_lag1, pm25_lag24, pm25_roll24,
      coalesce(w.temperature, st.temperature) as temperature, coalesce(w.humidity, st.humidity) as humidity,
      coalesce(w.wind_speed, st.wind_speed) as wind_speed
    from st cross join (select unnest(range(24)) as k) left join weather w
      on w.station_id = st.station_id and w.ts_hour = date_trunc('hour', st.ts) + to_hours(k::int))),
  x as (select h.*, [hour(ts), dayofweek(ts) + 1, month(ts), 0, temperature, humidity, wind_speed, blh_m]::double[] as v from h),
  f(station_id, step, pm25, roll) as (
    select station_id, 0::bigint, pm25, pm25_roll24 * 0.95 + pm25 * 0.05 from (
      select *, greatest(round(b + list_dot_product(w, list_concat([pm25_lag1, pm25_lag24, pm25_roll24], v)), 1), 6.0) as pm25 from x, model where step = 0)
    union all
    select station_id, step, pm25, roll * 0.95 + pm25 * 0.05 from (
      select x.station_id, x.step, f.roll, greatest(round(b + list_dot_product(w, list_concat([f.pm25, x.pm25_lag24, f.roll], v)), 1), 6.0) as pm25
      from f join x on x.station_id = f.station_id and x.step = f.step + 1, model))
  select f.station_id, f.step, x.ts, f.pm25, {CEIL_SQL.replace('pm25', 'f.pm25')} as aqi
  from f join x on x.station_id = f.station_id and x.step = f.step"""


def last_state(data):
    cols = ["pm25_lag1", "pm25_lag24", "pm25_roll24", "temperature", "humidity", "wind_speed"]
    return data.groupBy("station_id").agg(F.max("ts").alias("ts"), *[F.max_by(k, "ts").alias(k) for k in cols])


@query("m10_day_ahead_model", sql(LINE_SQL + AHEAD_SQL, "wide", "weather"), rounds={"pm25": 6})
def m10(t):
    data = split_of(t)
    return forecast.day_ahead_model(last_state(data), forecast.fit_line(data), t.weather, features=forecast.feature_columns(data))


@query("m10_day_ahead_trees")
def m10_trees(t):
    data = split_of(t)
    return forecast.day_ahead_model(last_state(data), forecast.fit(data, forecast.candidates()["RandomForest"]), t.weather)


@query("s16_model_roundtrip", sql(LINE_SQL + HELD_OUT, "wide", "weather"), rounds=LINE)
def s16(t):
    """The fitted line, stored as a table of one row and read again."""
    data = split_of(t)
    return forecast.score_line(cut_lineage(forecast.fit_line(data), "line"), data)


@query("s16_pipeline_roundtrip")
def s16_pipeline(t):
    data = split_of(t)
    path = scratch_path(t.spark, "model")
    forecast.save_model(forecast.fit(data, forecast.candidates()["LinearRegression"]), path)
    return forecast.score(PipelineModel.load(path), data)
