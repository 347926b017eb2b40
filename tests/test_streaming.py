"""Streams that arrive in several files, late and twice, against the batch result."""

import pytest
from pyspark.sql import functions as F

from hazegrid.streaming import live

SCHEMA = "event_id long, station_id string, ts timestamp, parameter string, value double"


def write(spark, folder, name, data):
    df = spark.createDataFrame(data, "event_id long, station_id string, t string, parameter string, value double")
    df.select("event_id", "station_id", F.col("t").cast("timestamp").alias("ts"), "parameter", "value").coalesce(1).write.parquet(
        f"{folder}/{name}")


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


@pytest.fixture()
def folder(spark, tmp_path):
    write(spark, tmp_path, "a", [(1, "A", "2024-01-01 00:10:00", "pm25", 10.0), (2, "A", "2024-01-01 00:50:00", "pm25", 30.0),
                                 (3, "B", "2024-01-01 00:20:00", "pm25", 950.0)])
    write(spark, tmp_path, "b", [(2, "A", "2024-01-01 00:50:00", "pm25", 30.0), (4, "A", "2024-01-01 00:45:00", "pm25", 50.0),
                                 (5, "B", "2024-01-01 01:05:00", "pm25", 40.0)])
    write(spark, tmp_path, "c", [(6, "A", "2024-01-01 05:00:00", "pm25", 5.0)])
    return tmp_path


@pytest.fixture()
def out_path(tmp_path_factory):
    return tmp_path_factory.mktemp("out") / "t"


def test_a_stream_goes_on_where_it_stopped(spark, folder, out_path):
    def run():
        rows = live.run_available(live.without_repeats(source(spark, folder), delay="100 hours"), str(out_path)).collect()
        newest = live.run_updates(live.latest_valid(source(spark, folder)), str(out_path) + "-latest", ["station_id"]).collect()
        return sorted(r.event_id for r in rows), {r.station_id: r.value for r in newest}
    assert run() == ([1, 2, 3, 4, 5, 6], {"A": 5.0, "B": 40.0})
    assert run() == ([1, 2, 3, 4, 5, 6], {"A": 5.0, "B": 40.0})
    write(spark, folder, "d", [(6, "A", "2024-01-01 05:00:00", "pm25", 5.0), (7, "B", "2024-01-01 06:00:00", "pm25", 8.0),
                               (8, "B", "2024-01-01 06:00:00", "pm25", 9.0)])
    assert run() == ([1, 2, 3, 4, 5, 6, 7, 8], {"A": 5.0, "B": 9.0})


def test_repeats_across_files(spark, folder, out_path):
    out = live.run_available(live.without_repeats(source(spark, folder), delay="1 hour"), str(out_path))
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3, 4, 5, 6]


def test_hours_close_after_the_watermark(spark, folder, out_path):
    unique = live.hourly_means(source(spark, folder).dropDuplicates(["event_id", "ts"]), "1 hour")
    got = {(r.station_id, r.hour_start.hour): (r.mean_value, r.n) for r in live.run_available(unique, str(out_path)).collect()}
    assert got == {("A", 0): (30.0, 3), ("B", 0): (950.0, 1), ("B", 1): (40.0, 1)}     # 5 o'clock is still open


def test_latest_ignores_impossible_values(spark, folder, out_path):
    out = live.run_updates(live.latest_valid(source(spark, folder)), str(out_path), ["station_id"])
    assert {r.station_id: r.value for r in out.collect()} == {"A": 5.0, "B": 40.0}


def test_daily_windows_equal_direct_ones(spark, folder):
    batch = spark.read.schema(SCHEMA).parquet(f"{folder}/*")
    direct = batch.groupBy("station_id", "parameter", F.window("ts", "24 hours", "1 hour").alias("w")).agg(
        F.avg("value").alias("m"), F.count("value").alias("n")).select("station_id", F.col("w.end").alias("e"), "m", "n")
    got = live.daily_means_hourly(batch).select("station_id", "window_end", "mean_value", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, direct.collect()))


def test_aqi_on_the_stream(spark, folder, out_path):
    got = live.run_available(live.hourly_aqi(source(spark, folder), "1 hour"), str(out_path)).collect()
    assert {r.aqi_cat for r in got if r.station_id == "B"} == {"Hazardous", "Unhealthy for Sensitive Groups"}
