"""Landed JSON of stations, measurements and weather as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.functions.geo import inside_box
from hazegrid.functions.units import is_tracked, parameter_name
from hazegrid.schema import READING, WEATHER_RENAME
from hazegrid.sources.tables import JSON_TIMES

# Shapes of the landed records; fields that are not used are not parsed.
STATION_JSON = "id string, name string, coordinates struct<latitude:double,longitude:double>, " \
    "sensors array<struct<id:bigint,parameter:struct<name:string>>>"
MEASUREMENT_JSON = "station_id string, parameter_name string, value double, " \
    "parameter struct<units:string>, unit string, " \
    "period struct<datetimeFrom:struct<utc:string,local:string>>, datetime struct<utc:string>, " \
    "coordinates struct<latitude:double,longitude:double>"
WEATHER_JSON = "station_id string, hourly struct<time:array<string>," + ",".join(
    f"{c}:array<double>" for c in WEATHER_RENAME) + ">"


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Line-delimited records, split across tasks; the schema is given, so nothing is scanned
    to infer it."""
    return spark.read.schema(schema).options(**JSON_TIMES).json(path)


CORRUPT = "_corrupt_record"


def read_checked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As `read_json`, with the text of a line that is no such record in ``_corrupt_record`` (null for good lines), so that no line is lost
    without a trace. Fields of the wrong type make a line corrupt too."""
    whole = T.StructType.fromDDL(schema).add(CORRUPT, T.StringType())
    return spark.read.schema(whole).options(**JSON_TIMES, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).json(path)


def rejects(records: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """``reason`` and ``record`` (the line, or the record as JSON) of the records of `read_checked` that are corrupt or meet one of the `reasons`,
    the first of them. Every record is either here or passes all reasons."""
    why = F.when(F.col(CORRUPT).isNotNull(), "malformed")
    for name, test in reasons.items():
        why = why.when(F.coalesce(test, F.lit(False)), name)
    fields = [c for c in records.columns if c != CORRUPT]
    return records.select(why.alias("reason"), F.coalesce(CORRUPT, F.to_json(F.struct(*fields))).alias("record")).where("reason is not null")


def station_reasons() -> dict[str, Column]:
    """Why `stations` leaves a record out, wherever the box is."""
    tracked = F.exists("sensors", lambda s: s["id"].isNotNull() & is_tracked(parameter_name(s["parameter"]["name"])))
    return {"no coordinates": F.col("coordinates.latitude").isNull() | F.col("coordinates.longitude").isNull(),
            "no tracked sensor": ~F.coalesce(tracked, F.lit(False))}


def measurement_reasons() -> dict[str, Column]:
    """Why `measurements` leaves a record out."""
    return {"no time": _local_or_utc().isNull(), "unreadable time": F.try_to_timestamp(_local_or_utc()).isNull(), "no value": F.col("value").isNull()}


def weather_reasons() -> dict[str, Column]:
    """Why `weather` gets no hour from a record."""
    return {"no hours": F.coalesce(F.size("hourly.time"), F.lit(0)) < 1}


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records out of stored response pages, one page per line with its records in
    ``results``; an empty page adds nothing."""
    pages = read_json(spark, path, f"results array<struct<{_as_fields(schema)}>>")
    return pages.select(F.explode("results").alias("_r")).select("_r.*")


def _as_fields(schema: str) -> str:
    return T.StructType.fromDDL(schema).simpleString()[len("struct<"):-1]


def stations(pages: DataFrame, box: dict[str, float] | None = None) -> DataFrame:
    """Station table from station records.

    Stations without coordinates, outside the box or without a sensor for a tracked
    pollutant are left out; a missing name becomes ``station_<id>``.
    """
    lat, lon = F.col("coordinates.latitude"), F.col("coordinates.longitude")
    usable = F.filter(
        F.transform("sensors", lambda s: F.struct(
            s["id"].alias("sensor_id"), parameter_name(s["parameter"]["name"]).alias("parameter"))),
        lambda s: s["sensor_id"].isNotNull() & is_tracked(s["parameter"]))
    kept = pages.where(lat.isNotNull() & lon.isNotNull()).select(
        F.col("id").alias("station_id"),
        F.coalesce("name", F.concat(F.lit("station_"), F.col("id"))).alias("station_name"),
        lat.alias("latitude"), lon.alias("longitude"), usable.alias("sensors")).where(F.size("sensors") > 0)
    return kept if box is None else kept.where(inside_box(F.col("latitude"), F.col("longitude"), box))


def sensors(station_table: DataFrame) -> DataFrame:
    """One row per sensor."""
    return station_table.select("station_id", F.explode("sensors").alias("s")).select("station_id", "s.*")


def _local_or_utc() -> Column:
    return F.coalesce("period.datetimeFrom.local", "period.datetimeFrom.utc", "datetime.utc")


def measurements(records: DataFrame, default_unit: str = "µg/m³") -> DataFrame:
    """Long readings from measurement records; records without time or value are left out.

    The local time carries its offset, so it is read as an instant and kept as UTC.
    """
    ts = F.try_to_timestamp(_local_or_utc()).cast("timestamp_ntz")
    return records.select(
        "station_id", ts.alias("ts"), parameter_name(F.col("parameter_name")).alias("parameter"), "value",
        F.coalesce("parameter.units", "unit", F.lit(default_unit)).alias("unit"),
        F.col("coordinates.latitude").alias("latitude"), F.col("coordinates.longitude").alias("longitude"),
    ).where(F.col("ts").isNotNull() & F.col("value").isNotNull())


def weather(records: DataFrame) -> DataFrame:
    """Hourly rows from parallel arrays; a variable that was not sent becomes a null column."""
    # Zipping with a null array gives null and would lose the rows, so it becomes empty first.
    sent = [F.coalesce(f"hourly.{c}", F.array().cast("array<double>")).alias(c) for c in WEATHER_RENAME]
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"), *sent)
    rows = records.select("station_id", F.explode(zipped).alias("h"))
    return rows.select(
        "station_id", F.try_to_timestamp("h.time").cast("timestamp_ntz").alias("ts_hour"),
        *[F.col(f"h.{raw}").alias(name) for raw, name in WEATHER_RENAME.items()])


def within_days(readings: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Readings from the first day up to the end of the last; bounds are literals, so they
    reach the file scan."""
    start = F.lit(first_day).cast("timestamp_ntz")
    end = (F.lit(last_day).cast("date") + F.expr("interval 1 day")).cast("timestamp_ntz")
    return readings.where((F.col("ts") >= start) & (F.col("ts") < end))


def empty_readings(spark: SparkSession) -> DataFrame:
    """No rows, full schema."""
    return spark.createDataFrame([], READING)
