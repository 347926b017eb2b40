"""Landed files through the store to result tables and a model."""

import json
import math
from datetime import datetime, timedelta

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from hazegrid.plans import flows

START = datetime(2024, 1, 1)


def lines(path, records):
    path.write_text("\n".join(json.dumps(r) for r in records))
    return str(path)


def test_flow(spark, tmp_path):
    hours = [START + timedelta(hours=h) for h in range(120)]
    sensor = lambda i, n: {"id": i, "parameter": {"name": n}}
    stations = lines(tmp_path / "s.json", [
        {"id": s, "name": n, "coordinates": {"latitude": 23.7, "longitude": 90.4}, "sensors": [sensor(1, "pm25"), sensor(2, "pm10")]}
        for s, n in (("007", "Mirpur, Road 1"), ("6240023", "Elsewhere"))])
    measured = [
        {"station_id": s, "parameter_name": p, "value": v, "period": {"datetimeFrom": {"utc": t.isoformat() + "Z"}}}
        for s, k in (("007", 40.0), ("6240023", 90.0)) for i, t in enumerate(hours)
        for p, v in (("pm2.5", k + 20 * math.sin(i / 7) + i % 5), ("pm10", 2 * k)) if i % 17 or p == "pm10"]
    measured += measured[:10]
    measured.append({"station_id": "007", "parameter_name": "pm25", "value": 1.0,
                     "period": {"datetimeFrom": {"utc": "2020-01-01T00:00:00Z"}}})
    weather = lines(tmp_path / "w.json", [
        {"station_id": s, "hourly": {"time": [t.isoformat() for t in hours], "temperature_2m": [20.0 + i % 9 for i in range(120)],
                                     "relative_humidity_2m": [50.0 + i % 11 for i in range(120)],
                                     "wind_speed_10m": [3.0 + i % 4 for i in range(120)]}} for s in ("007", "6240023")])
    store, results = str(tmp_path / "store"), str(tmp_path / "results")
    flows.build_store(spark, stations, lines(tmp_path / "m.json", measured), weather, store, "2024-01-01", "2024-01-05")

    df = flows.read_store(spark, store)
    assert df.count() == 240 and sorted(r[0] for r in df.select("station_id").distinct().collect()) == ["007", "6240023"]
    assert df.where("pm25 is null or temperature is null").count() == 0      # gaps of one hour are carried
    assert df.where("no2 is not null or pressure is not null").count() == 0
    people = {r.station_id: r.population_catchment for r in df.select("station_id", "population_catchment").distinct().collect()}
    assert people == {"007": int(38_000 * math.pi * 9), "6240023": 650_309}

    flows.analyse(spark, store, results)
    ranking = spark.read.option("header", True).option("inferSchema", True).csv(f"{results}/health_ranking_summary").collect()
    assert [r["rank"] for r in ranking] == [1, 2] and {r.season for r in ranking} == {"Winter"}
    burden = spark.read.option("header", True).csv(f"{results}/health_burden_table")
    assert burden.count() == 4
    stats = {r.column: r for r in spark.read.option("header", True).csv(f"{results}/summary_statistics").collect()}
    assert int(stats["pm25"].n) == 240 and float(stats["no2"].null_pct) == 100.0
    assert spark.read.parquet(f"{results}/enriched_data").count() == 240

    line = {"LinearRegression": LinearRegression(featuresCol="features", labelCol="target", maxIter=20)}
    best = flows.train(spark, store, results, line)
    facts = spark.read.json(f"{results}/model_metadata").first()
    assert facts.model_name == best and facts.training_rows + facts.test_rows == 2 * (120 - 25)
    assert spark.read.option("header", True).csv(f"{results}/test_predictions").count() == facts.test_rows

    box = {r.season: r for r in spark.read.option("header", True).csv(f"{results}/seasonal_box").collect()}
    assert set(box) == {"Winter"} and spark.read.option("header", True).csv(f"{results}/wind_profile").count() == 8
    assert spark.read.option("header", True).csv(f"{results}/weekly_trend").count() == 10

    later = lines(tmp_path / "later.json", [{"station_id": "007", "hourly": {
        "time": [(hours[-1] + timedelta(hours=h)).isoformat() for h in range(24)], "temperature_2m": [30.0] * 24,
        "relative_humidity_2m": [40.0] * 24, "wind_speed_10m": [1.0] * 24}}])

    def read(name):
        return spark.read.option("header", True).option("inferSchema", True).csv(f"{results}/{name}").collect()

    # once with the line, once with the formulas, whichever won
    fitted = flows.forecast.fit(flows.forecast.training_table(df), line["LinearRegression"])
    flows.forecast.save_model(fitted, f"{results}/model")
    for name in ("LinearRegression", flows.forecast.BASELINE):
        flows.tables.write_metadata(spark, f"{results}/model_metadata", model_name=name)
        flows.serve(spark, store, results, later)
        soon, ahead, peaks = read("next_hour"), read("day_ahead"), read("day_ahead_peak")
        assert len(soon) == 2 and {r.ts for r in soon} == {hours[-1] + timedelta(hours=1)}
        last = {r.station_id: r.pm25 for r in df.where(f"ts = '{hours[-1]}'").collect()}
        assert all(r.last_pm25 == last[f"{r.station_id:03}"] and r.next_pm25 >= 5 and r.aqi_cat and r.mask for r in soon)
        assert sorted((r.station_id, r.step, r.ts) for r in ahead) == [(s, h, hours[-1] + timedelta(hours=h)) for s in (7, 6240023) for h in range(24)]
        assert {(r.station_id, r.peak_pm25) for r in peaks} == {(s, max(r.pm25 for r in ahead if r.station_id == s)) for s in (7, 6240023)}
        if name == "LinearRegression":
            state = flows.live_state(df)
            plain = fitted.transform(flows.with_calendar(state).withColumn("blh_m", flows.boundary_layer_height(
                F.hour("ts"), F.month("ts"), F.col("temperature"), F.col("wind_speed"))))
            assert {int(r.station_id): max(round(r.prediction, 1), 5.0) for r in plain.collect()} == {r.station_id: r.next_pm25 for r in soon}


def test_store_with_population_cells(spark, tmp_path):
    stations = lines(tmp_path / "s.json", [{"id": "1", "name": "A", "coordinates": {"latitude": 23.7, "longitude": 90.4},
                                            "sensors": [{"id": 1, "parameter": {"name": "pm25"}}]}])
    measured = lines(tmp_path / "m.json", [{"station_id": "1", "parameter_name": "pm25", "value": 9.0,
                                            "period": {"datetimeFrom": {"utc": "2024-01-01T00:00:00Z"}}}])
    weather = lines(tmp_path / "w.json", [{"station_id": "1", "hourly": {"time": ["2024-01-01T00:00"], "temperature_2m": [20.0]}}])
    cells = spark.createDataFrame([(1, 23.7, 90.4, 100.0), (2, 23.71, 90.41, 20.0), (3, 24.7, 90.4, 7.0)], "cell_id long, lat double, lon double, pop double")
    flows.build_store(spark, stations, measured, weather, str(tmp_path / "store"), "2024-01-01", "2024-01-02", cells=cells)
    assert [r.population_catchment for r in flows.read_store(spark, str(tmp_path / "store")).collect()] == [120]


def test_live_readings(spark, tmp_path):
    """Files arrive in two calls, with repeats, a late reading, an impossible value and a corrected unit; results equal a plain count."""
    folder, results = tmp_path / "landed", str(tmp_path / "live")
    folder.mkdir()

    def reading(station, minute, value, unit="µg/m³"):
        return {"station_id": station, "parameter_name": "pm2.5", "value": value, "unit": unit,
                "period": {"datetimeFrom": {"utc": (START + timedelta(minutes=minute)).isoformat() + "Z"}}}

    flows.follow(spark, str(folder), results, "1 hour")          # nothing has landed yet
    first = [reading("007", m, 20.0 + m % 7) for m in range(0, 600, 10)] + [reading("8", m, 55.0) for m in range(0, 600, 30)]
    lines(folder / "a.json", first + first[:9] + [reading("8", 605, -4.0), {"station_id": "8", "value": 3.0}])
    flows.follow(spark, str(folder), results, "1 hour")

    def hours():
        return {(r.station_id, r.hour_start.hour): (round(r.mean_value, 6), r.n) for r in spark.read.parquet(f"{results}/hourly/rows").collect()}

    def plain(readings, last):
        found = {}
        for r in readings:
            at = datetime.fromisoformat(r["period"]["datetimeFrom"]["utc"][:-1])
            if at < START + timedelta(hours=last):
                found.setdefault((r["station_id"], at.hour), []).append(r["value"])
        return {k: (round(sum(v) / len(v), 6), len(v)) for k, v in found.items()}

    def newest():
        rows = spark.read.option("header", True).csv(f"{results}/latest_aqi").collect()
        return {int(r.station_id): (r.ts[11:16], float(r.pm25)) for r in rows if r.aqi_cat and r.mask}

    assert hours() == plain(first, 8)          # the newest reading is of 9:50, so 8:50 is the watermark
    assert newest() == {7: ("09:50", 20.0 + 590 % 7), 8: ("09:30", 55.0)}

    second = [reading("007", m, 30.0) for m in range(600, 900, 20)]
    lines(folder / "b.json", second + first[-5:] + [reading("007", 15, 500.0)])       # repeats, and one long after its hour
    flows.follow(spark, str(folder), results, "1 hour")
    assert hours() == plain(first + second, 13)
    assert newest() == {7: ("14:40", 30.0), 8: ("09:30", 55.0)}
    assert spark.read.parquet(f"{results}/readings/rows").count() == len(first) + len(second)
    done = hours()
    flows.follow(spark, str(folder), results, "1 hour")
    assert hours() == done
    index = {(r.station_id, r.hour_start.hour): r.aqi for r in spark.read.parquet(f"{results}/hourly_aqi/rows").collect()}
    assert index.keys() == done.keys() and index["8", 3] == 149
    day = spark.read.parquet(f"{results}/daily/rows").where("station_id = '8'").groupBy("window_end").count()
    assert day.where("count > 1").isEmpty() and day.count() == 13


def test_long_store(spark, tmp_path):
    """One outlier, one impossible value, repeats and a day without a good reading, against values worked out by hand."""
    stations = lines(tmp_path / "s.json", [{"id": "1", "name": "A", "coordinates": {"latitude": 23.7, "longitude": 90.4},
                                            "sensors": [{"id": 1, "parameter": {"name": "pm25"}}]}])
    values = {h: 20.0 + h % 5 for h in range(48)}
    values |= {10: 900.0, 20: -1.0, 21: -1.0, 22: -1.0, 23: -1.0}
    values |= {h: -1.0 for h in range(48, 72)}

    def reading(hour, value):
        return {"station_id": "1", "parameter_name": "pm25", "value": value,
                "period": {"datetimeFrom": {"utc": (START + timedelta(hours=hour)).isoformat() + "Z"}}}

    landed = [reading(h, v) for h, v in values.items()]
    landed += [reading(3, 800.0), reading(20, -1.0), reading(30, values[30]), reading(24 * 40, 5.0)]
    store, results = str(tmp_path / "store"), str(tmp_path / "results")
    flows.build_long_store(spark, stations, lines(tmp_path / "m.json", landed), store, results, "2024-01-01", "2024-01-31")

    rows = {round((r.ts - START).total_seconds() / 3600): r for r in spark.read.parquet(store).collect()}
    assert sorted(rows) == list(range(72)) and {(r.station_name, str(r.month)) for r in rows.values()} == {("A", "1")}
    assert rows[10].is_outlier and rows[10].value == 900.0 and rows[10].value_clean == values[9]
    assert rows[3].value == values[3] and not rows[3].is_outlier                # the smaller of two
    assert [rows[h].value_clean for h in (20, 21, 22)] == [values[19]] * 3      # three readings back at most
    good = sorted(v for h, v in values.items() if h < 20 and h != 10)
    assert rows[23].value is None and rows[23].value_clean == good[(len(good) - 1) // 2]
    assert [rows[h].value_clean for h in (48, 50)] == [values[47]] * 2
    assert all(rows[h].value_clean is None for h in range(51, 72))              # that day has no median
    outliers = spark.read.option("header", True).csv(f"{results}/outlier_summary").collect()
    assert [(r.parameter, int(r.valid_records), int(r.outliers_flagged)) for r in outliers] == [("pm25", 43, 1)]
    hourly = {r.ts: r.pm25 for r in spark.read.parquet(f"{results}/hourly").collect()}
    assert len(hourly) == 72 and hourly[START + timedelta(hours=10)] == values[9]
