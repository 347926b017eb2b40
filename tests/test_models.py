"""Feature frame, split, models and day-ahead recursion."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from hazegrid.operators import fitted, forecast

c = F.col


@pytest.fixture(scope="module")
def linear(spark):
    """Two stations whose next value is a line in the features."""
    rng = spark.range(400).select(
        F.concat(F.lit("S"), (c("id") % 2).cast("string")).alias("station_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id / 2 as int))").alias("ts"),
        *[(F.rand(seed) * 50 + 5).alias(n) for seed, n in enumerate(["pm25_lag1", "pm25_lag24", "pm25_roll24"])],
        F.hour(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id / 2 as int))")).alias("hour"),
        F.lit(2).alias("dow"), (c("id") % 12 + 1).cast("int").alias("month"), (c("id") % 4).cast("int").alias("season_code"))
    rows = rng.withColumn("target", c("pm25_lag1") * 0.6 + c("pm25_roll24") * 0.3 + c("hour") * 0.1 + 2)
    return forecast.chronological_split(rows).cache()


def test_split_is_by_time_per_station(linear):
    for r in linear.groupBy("station_id").agg(F.count_if("is_train").alias("k"), F.count("*").alias("n")).collect():
        assert (r.k, r.n) == (160, 200)


def test_line_is_found(linear):
    model = forecast.fit(linear, forecast.candidates()["LinearRegression"])
    m = forecast.regression_metrics(forecast.score(model, linear)).first()
    assert m.rmse < 1e-3 and m.r2 > 0.9999 and m.n == 80


def test_assembler_skips_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (3.0, float("nan"))], "a double, b double")
    assert forecast.assembler(["a", "b"]).transform(df).count() == 1


def test_comparison_and_winner(linear):
    trees = RandomForestRegressor(featuresCol="features", labelCol="target", numTrees=5, maxDepth=3, seed=1)
    table, models = forecast.compare(
        linear, {"LinearRegression": forecast.candidates()["LinearRegression"], "RandomForest": trees})
    rows = {r.model: r for r in table.collect()}
    assert set(rows) == {forecast.BASELINE, "LinearRegression", "RandomForest"}
    assert forecast.winner(table) == "LinearRegression" and rows[forecast.BASELINE].skill_pct == 0.0
    assert rows["LinearRegression"].skill_pct > 99
    imp = forecast.feature_importance(models["RandomForest"]).collect()
    assert imp[0].feature == "pm25_lag1" and sum(r.importance for r in imp) == pytest.approx(1.0)
    assert forecast.feature_importance(models["LinearRegression"]) is None


def test_baseline_may_win(linear):
    easy = linear.withColumn("target", c("pm25_lag1"))
    stiff = LinearRegression(featuresCol="features", labelCol="target", regParam=1e6)
    table, models = forecast.compare(easy, {"stiff": stiff})
    assert forecast.winner(table) == forecast.BASELINE and forecast.BASELINE not in models


def test_saved_model_scores_the_same(linear, tmp_path):
    model = forecast.fit(linear, forecast.candidates()["LinearRegression"])
    for _ in range(2):          # the second save replaces the first
        forecast.save_model(model, str(tmp_path / "m"))
    again = forecast.score(PipelineModel.load(str(tmp_path / "m")), linear)
    diff = again.join(forecast.score(model, linear).withColumnRenamed("prediction", "p"), ["station_id", "ts"])
    assert diff.agg(F.max(F.abs(c("prediction") - c("p")))).first()[0] < 1e-12


def test_metrics_edges(spark):
    same = spark.createDataFrame([(5.0, 4.0), (5.0, 6.0)], "target double, prediction double")
    m = forecast.regression_metrics(same).first()
    assert (m.rmse, m.mae, m.r2, m.n) == (1.0, 1.0, None, 2)
    none = forecast.regression_metrics(same.where("target < 0")).first()
    assert (none.rmse, none.r2, none.n) == (None, None, 0)


def test_metrics_match_mllib(linear):
    from pyspark.ml.evaluation import RegressionEvaluator
    preds = forecast.persistence(linear)
    ours = forecast.regression_metrics(preds).first()
    for name in ("rmse", "mae", "r2"):
        want = RegressionEvaluator(labelCol="target", metricName=name).evaluate(preds)
        assert ours[name] == pytest.approx(want)


def test_day_ahead_formula_by_hand(spark):
    state = spark.sql("select 'A' as station_id, timestamp_ntz'2024-01-31 23:00:00' as ts, 100.0d as pm25, "
                      "20.0d as temperature, 2.0d as wind_speed")
    got = forecast.day_ahead_formula(state, hours=3).orderBy("step").collect()
    lag = 100.0
    for r in got:
        lag = max(6.0, round(lag * 0.85 + 800.0 / r.blh_m * 15.0, 1))
        assert r.pm25 == pytest.approx(lag, abs=0.051)
        lag = r.pm25
    assert [str(r.ts) for r in got] == ["2024-01-31 23:00:00", "2024-02-01 00:00:00", "2024-02-01 01:00:00"]


def test_day_ahead_formula_takes_the_weather_of_each_hour(spark):
    state = spark.sql("select 'A' as station_id, timestamp_ntz'2024-01-10 05:00:00' as ts, 100.0d as pm25, 20.0d as temperature, 2.0d as wind_speed")
    weather = spark.sql("select 'A' as station_id, timestamp_ntz'2024-01-10 06:00:00' as ts_hour, 35.0d as temperature, 30.0d as wind_speed")
    still = {r.step: r for r in forecast.day_ahead_formula(state, None, 3).collect()}
    got = {r.step: r for r in forecast.day_ahead_formula(state, weather, 3).collect()}
    assert got[0] == still[0] and got[2].blh_m == still[2].blh_m
    assert got[1].blh_m > still[1].blh_m and got[1].pm25 < still[1].pm25 and got[2].pm25 < still[2].pm25
    assert all(r.aqi is not None for r in got.values())


def test_a_value_from_before_the_spine_is_carried(spark):
    from hazegrid.operators import joins
    df = spark.sql("select * from values ('A', timestamp_ntz'2024-01-01 00:00:00', 7.0d), ('A', timestamp_ntz'2024-01-04 02:00:00', null), "
                   "('B', timestamp_ntz'2024-01-04 02:00:00', 3.0d) as v(station_id, ts, pm25)")
    got = {r.station_id: (r.pm25_lag1, r.pm25_lag24) for r in forecast.live_vector(joins.on_spine(df, 72, carry=("pm25",))).collect()}
    assert got == {"A": (7.0, 7.0), "B": (3.0, None)}


def test_day_ahead_model_follows_its_own_predictions(spark, linear):
    model = forecast.fit(linear, forecast.candidates()["LinearRegression"])
    state = spark.sql("select 'A' as station_id, timestamp_ntz'2024-01-31 22:00:00' as ts, 30.0d as pm25_lag1, 20.0d as pm25_lag24, "
                      "25.0d as pm25_roll24, 20.0d as temperature, 50.0d as humidity, 2.0d as wind_speed")
    got = forecast.day_ahead_model(state, model, hours=5).orderBy("step").collect()
    lag, roll = 30.0, 25.0
    for r, hour in zip(got, (22, 23, 0, 1, 2)):
        want = max(6.0, lag * 0.6 + roll * 0.3 + hour * 0.1 + 2)
        assert r.pm25 == pytest.approx(want, abs=0.06)
        lag, roll = r.pm25, 0.95 * roll + 0.05 * r.pm25
    assert len(got) == 5 and str(got[2].ts) == "2024-02-01 00:00:00"


NAMES = ["a", "b", "flat", "twice", "none"]


@pytest.mark.parametrize("parts", [1, 5])
def test_least_squares_from_merged_moments(spark, parts):
    """Equal to a dense solution, far from zero and on very different scales; a constant feature and one that others explain get no weight; nulls are left out."""
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.normal(1e6, 3.0, 500), rng.normal(-2.0, 1e-3, 500)
    y = 5.0 * a - 700.0 * b + rng.normal(0, 0.1, 500)
    data = [(float(x), float(z), 7.0, float(2 * x + 1), float(i % 3), float(t)) for i, (x, z, t) in enumerate(zip(a, b, y, strict=True))]
    df = spark.createDataFrame([*data, (None, 1.0, 7.0, 1.0, 1.0, 1e9), (1.0, 1.0, 7.0, 1.0, 1.0, None)],
                               "a double, b double, flat double, twice double, none double, target double").repartition(parts)
    m = fitted.fit_linear(df, NAMES).first()
    x = np.array(data)[:, [0, 1, 4]]
    centred = x - x.mean(axis=0)
    want = np.linalg.lstsq(centred, y - y.mean(), rcond=None)[0]
    assert m.n == 500 and m.features == NAMES and m.coefficients[2] == m.coefficients[3] == 0.0
    assert [m.coefficients[i] for i in (0, 1, 4)] == pytest.approx(want.tolist(), rel=1e-6)
    assert m.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ want, rel=1e-6)
    empty = fitted.fit_linear(df.where("false"), NAMES).first()
    assert empty.n == 0 and empty.intercept is None and set(empty.coefficients) == {0.0}


def test_line_from_moments_equals_the_estimator(linear):
    line = forecast.score_line(forecast.fit_line(linear), linear).withColumnRenamed("prediction", "p")
    both = line.join(forecast.score(forecast.fit(linear, forecast.candidates()["LinearRegression"]), linear), ["station_id", "ts"])
    assert both.count() == 80 and both.agg(F.max(F.abs(c("p") - c("prediction")))).first()[0] < 1e-4


@pytest.fixture(scope="module")
def ensembles(linear):
    from pyspark.ml.regression import GBTRegressor

    how = {"featuresCol": "features", "labelCol": "target", "seed": 3}
    return {"forest": forecast.fit(linear, RandomForestRegressor(numTrees=7, maxDepth=5, **how)),
            "boosted": forecast.fit(linear, GBTRegressor(maxIter=6, maxDepth=3, stepSize=0.2, **how))}


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_node_tables_predict_as_the_model(spark, linear, ensembles, kind, tmp_path):
    """As column expressions, and in SQL from the stored table, by another engine."""
    import duckdb

    model = ensembles[kind]
    cols = forecast.feature_columns(linear)
    nodes = fitted.node_table(model)
    nodes.write.parquet(str(tmp_path / "nodes"))
    want = {(r.station_id, r.ts): r.prediction for r in model.transform(linear).collect()}
    ours = fitted.score_forest(linear, nodes, cols, model.stages[-1].getMaxDepth(), "p")
    ours.select("station_id", "ts", "p", *cols).write.parquet(str(tmp_path / "rows"))
    for r in ours.collect():
        assert r.p == pytest.approx(want[r.station_id, r.ts], abs=1e-9)
    split_on = " ".join(f"when '{x}' then r.{x}" for x in cols)
    wrong = duckdb.sql(f"""
      with recursive n as (select * from '{tmp_path}/nodes/*.parquet'), r as (select * from '{tmp_path}/rows/*.parquet'),
      walk as (select r.*, n.tree, n.node from r, n where n.node = 0
        union all select walk.* exclude (node), case when (case n.feature {split_on.replace('r.', 'walk.')} end) <= n.split then n.left else n.right end
        from walk join n on n.tree = walk.tree and n.node = walk.node where n.feature is not null)
      select count(*), count(*) filter (where abs(v - p) > 1e-9) from (
        select station_id, ts, any_value(p) as p, sum(tree_weight * value) as v from walk join n on n.tree = walk.tree and n.node = walk.node
        where n.feature is null group by all)""").fetchall()
    assert wrong == [(400, 0)]


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_importances_from_node_tables(linear, ensembles, kind):
    model = ensembles[kind]
    got = {r.feature: r.importance for r in fitted.tree_importance(fitted.node_table(model), per_tree=kind == "forest").collect()}
    for name, want in zip(forecast.feature_columns(linear), model.stages[-1].featureImportances.toArray(), strict=True):
        assert got.get(name, 0.0) == pytest.approx(want, abs=1e-9)


def test_day_ahead_by_trees_is_one_fold(spark, linear, ensembles):
    """Equal to one transform per hour."""
    model = ensembles["forest"]
    state = spark.sql("select 'A' as station_id, timestamp_ntz'2024-01-31 22:00:00' as ts, 30.0d as pm25_lag1, 20.0d as pm25_lag24, "
                      "25.0d as pm25_roll24, 20.0d as temperature, 50.0d as humidity, 2.0d as wind_speed")
    out = forecast.day_ahead_model(state, model, hours=4)
    lag, roll = 30.0, 25.0
    for r, (hour, dow, month) in zip(out.orderBy("step").collect(), ((22, 4, 1), (23, 4, 1), (0, 5, 2), (1, 5, 2))):
        one = spark.createDataFrame([(lag, 20.0, roll, hour, dow, month, 0)], "pm25_lag1 double, pm25_lag24 double, pm25_roll24 double, "
                                    "hour int, dow int, month int, season_code int")
        lag = max(6.0, round(model.transform(one).first().prediction, 1))
        assert r.pm25 == pytest.approx(lag)
        roll = 0.95 * roll + 0.05 * lag


def test_many_stations_are_forecast_in_many_tasks(spark, linear, ensembles, rows):
    """The states of 250 stations are small enough for one task by their bytes, but not by the work of the fold."""
    state = spark.range(250).select(
        F.concat(F.lit("S"), "id").alias("station_id"), F.expr("timestamp_ntz'2024-01-31 22:00:00' + make_dt_interval(0, cast(id % 3 as int))").alias("ts"),
        (c("id") % 40 + 10.0).alias("pm25_lag1"), F.lit(20.0).alias("pm25_lag24"), (c("id") % 7 + 20.0).alias("pm25_roll24"),
        F.lit(20.0).alias("temperature"), F.lit(50.0).alias("humidity"), F.lit(2.0).alias("wind_speed"))
    weather = state.select("station_id", F.expr("date_trunc('hour', ts) + interval 1 hour").cast("timestamp_ntz").alias("ts_hour"),
                           F.lit(25.0).alias("temperature"), F.lit(40.0).alias("humidity"), F.lit(1.0).alias("wind_speed"))
    out = forecast.day_ahead_model(state, ensembles["forest"], weather, hours=4)
    got = rows(out)
    assert len(got) == 1000
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() == 3
    some = state.where("station_id in ('S0', 'S101', 'S249')")
    assert rows(forecast.day_ahead_model(some, ensembles["forest"], weather, hours=4)) == [r for r in got if r[0] in ("S0", "S101", "S249")]


def test_peak_takes_the_first_hour(spark):
    df = spark.createDataFrame([("A", 0, 5.0), ("A", 1, 9.0), ("A", 2, 9.0)], "station_id string, step int, pm25 double")
    r = forecast.peak(df).first()
    assert (r.peak_pm25, r.peak_step) == (9.0, 1)


def test_sample_is_repeatable(linear):
    a = forecast.seeded_sample(linear, ["station_id", "ts"], 0.25)
    b = forecast.seeded_sample(linear.repartition(7), ["station_id", "ts"], 0.25)
    key = lambda df: sorted((r.station_id, r.ts) for r in df.collect())
    assert key(a) == key(b) and 60 < len(key(a)) < 140
    assert key(forecast.seeded_sample(linear, ["station_id", "ts"], 0.25, seed=1)) != key(a)
    assert forecast.seeded_sample(linear, ["station_id"], 1.0).count() == 400
