"""Landed files and result tables."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid import session
from hazegrid.schema import POLLUTANTS, READING, WEATHER, WIDE, normalize
from hazegrid.sources import landed, tables


def land(tmp_path, records):
    path = tmp_path / "landed.json"
    path.write_text("\n".join(json.dumps(r) for r in records))
    return str(path)


def test_stations(spark, tmp_path):
    sensor = lambda i, n: {"id": i, "parameter": {"name": n}}
    path = land(tmp_path, [
        {"id": 1, "name": "One", "coordinates": {"latitude": 23.7, "longitude": 90.4},
         "sensors": [sensor(10, "pm25"), sensor(None, "no2"), sensor(11, "rh")]},
        {"id": 2, "coordinates": {"latitude": 23.65, "longitude": 90.5}, "sensors": [sensor(20, "PM10")]},
        {"id": 3, "name": "no place", "coordinates": {"latitude": None, "longitude": 90.4}, "sensors": [sensor(30, "co")]},
        {"id": 4, "name": "outside", "coordinates": {"latitude": 20.0, "longitude": 90.4}, "sensors": [sensor(40, "co")]},
        {"id": 5, "name": "no sensors", "coordinates": {"latitude": 23.7, "longitude": 90.4}, "sensors": []},
        {"id": 6, "name": "null sensors", "coordinates": {"latitude": 23.7, "longitude": 90.4}}])
    from hazegrid.schema import BBOX
    table = landed.stations(landed.read_json(spark, path, landed.STATION_JSON), BBOX)
    assert sorted((r.station_id, r.station_name) for r in table.collect()) == [("1", "One"), ("2", "station_2")]
    assert sorted(map(tuple, landed.sensors(table).collect())) == [("1", 10, "pm25"), ("2", 20, "pm10")]


def test_measurements(spark, tmp_path):
    path = land(tmp_path, [
        {"station_id": "1", "parameter_name": "PM2.5", "value": 4.5,
         "period": {"datetimeFrom": {"local": "2024-01-01T06:00:00+06:00", "utc": "1999-01-01T00:00:00Z"}}},
        {"station_id": "1", "parameter_name": "no2", "value": 1.0, "parameter": {"units": "ppb"},
         "datetime": {"utc": "2024-01-01T01:00:00Z"}},
        {"station_id": "1", "parameter_name": "no2", "value": None, "datetime": {"utc": "2024-01-01T01:00:00Z"}},
        {"station_id": "1", "parameter_name": "no2", "value": 3.0, "datetime": {"utc": "soon"}}])
    got = sorted((str(r.ts), r.parameter, r.value, r.unit) for r in landed.measurements(
        landed.read_json(spark, path, landed.MEASUREMENT_JSON)).collect())
    assert got == [("2024-01-01 00:00:00", "pm25", 4.5, "µg/m³"), ("2024-01-01 01:00:00", "no2", 1.0, "ppb")]


def test_pages_hold_records(spark, tmp_path):
    one = {"station_id": "1", "parameter_name": "co", "value": 2.0, "datetime": {"utc": "2024-01-01T01:00:00Z"}}
    path = land(tmp_path, [{"meta": {"found": 3}, "results": [one, one]}, {"results": []}, {"results": [one]}])
    records = landed.read_pages(spark, path, landed.MEASUREMENT_JSON)
    assert landed.measurements(records).count() == 3


def test_weather_arrays_of_unequal_length(spark, tmp_path):
    path = land(tmp_path, [
        {"station_id": "1", "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [20.5, None]}},
        {"station_id": "2", "hourly": {"time": []}}])
    got = landed.weather(landed.read_json(spark, path, landed.WEATHER_JSON)).orderBy("ts_hour").collect()
    assert [(r.station_id, r.temperature, r.pressure) for r in got] == [("1", 20.5, None), ("1", None, None)]


def test_window_keeps_the_last_day(spark):
    df = spark.sql("select cast(t as timestamp_ntz) as ts from values ('2024-01-04 23:59:59'), ('2024-01-05 00:00:00'), "
                   "('2024-01-06 23:59:59.999'), ('2024-01-07 00:00:00') as v(t)")
    assert landed.within_days(df, "2024-01-05", "2024-01-06").count() == 2


def test_filters_reach_the_file(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.sql("select timestamp_ntz'2024-01-05 10:00:00' as ts, 1.0d as a, 2.0d as b").write.parquet(path)
    plan = landed.within_days(spark.read.parquet(path), "2024-01-05", "2024-01-06").select("a")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in text and "b#" not in text.split("ReadSchema")[1]


def test_station_folders_stay_text(spark, tmp_path):
    path = str(tmp_path / "cleaned")
    df = spark.sql("select id as station_id, timestamp_ntz'2024-02-03 04:00:00' as ts, 1.5d as pm25 "
                   "from values ('007'), ('6240023') as v(id)")
    tables.write_by_station_month(df, path)
    back = tables.read_parquet(spark, path)
    assert dict(back.dtypes)["station_id"] == "string"
    assert sorted(r.station_id for r in back.collect()) == ["007", "6240023"]
    assert back.where("year = '2024' and month = '2'").count() == 2


def test_absent_csv_is_empty(spark, tmp_path):
    schema = T.StructType.fromDDL("a string, b double")
    assert tables.read_csv(spark, str(tmp_path / "none"), schema).count() == 0
    path = str(tmp_path / "some")
    tables.write_csv(spark.createDataFrame([("x, \"y\"", 1.5), (None, None)], schema), path)
    assert sorted(map(tuple, tables.read_csv(spark, path, schema).collect()), key=repr) == [("x, \"y\"", 1.5), (None, None)]


def test_json_keeps_microseconds(spark, tmp_path):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:07.179575' as ts")
    tables.write_json(df, str(tmp_path / "j"))
    assert landed.read_json(spark, str(tmp_path / "j"), df.schema).first().ts.microsecond == 179575


def test_normalize(spark):
    df = spark.createDataFrame([("1", 3, "x")], "station_id string, co int, extra string")
    out = normalize(df, WIDE)
    assert out.schema.fieldNames() == WIDE.fieldNames() and out.first().co == 3.0
    assert out.schema["pm25"].dataType == T.DoubleType() and out.first().pm25 is None
    assert normalize(df, WIDE, keep_extra=True).columns[-1] == "extra"
    assert landed.empty_readings(spark).schema.fieldNames() == READING.fieldNames()
    assert len(POLLUTANTS) == 6 and len(WEATHER) == 5


def test_metadata(spark, tmp_path):
    tables.write_metadata(spark, str(tmp_path / "m"), model="GBT", features=["a", "b"], rmse=1.5)
    got = spark.read.json(str(tmp_path / "m")).first()
    assert (got.model, got.features, got.rmse) == ("GBT", ["a", "b"], 1.5)


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = spark.range(5).withColumn("x", F.lit("a"))
    cut = session.cut_lineage(df, "t")
    assert cut.count() == 5 and cut.columns == df.columns
    assert session.shared_dir(spark) in cut.inputFiles()[0]


def test_cluster_needs_the_setting(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        applicationId, master = "app-without-folder", "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
