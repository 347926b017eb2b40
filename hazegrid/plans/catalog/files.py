"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.operators import joins, profile
from hazegrid.plans.catalog.registry import query
from hazegrid.plans.tables import sql
from hazegrid.schema import READING, WEATHER, WEATHER_HOURLY, normalize
from hazegrid.session import scratch_path
from hazegrid.sources import landed, tables as out

READING_COLS = "event_id, station_id, ts, parameter, value, unit"


def _land(df, name):
    path = scratch_path(df.sparkSession, name)
    out.write_json(df, path)
    return path


@query("s01_stations_json", """
  select 'ST' || s_suppkey::varchar as station_id,
    case when s_suppkey % 7 = 0 then 'station_ST' || s_suppkey::varchar else s_name end as station_name,
    round(23.65::double + s_suppkey / 1000.0::double, 6) as latitude, 90.4::double as longitude,
    s_suppkey * 10 + k as sensor_id, p as parameter
  from supplier, (values (1, 'pm25'), (2, 'pm10'), (5, 'so2')) v(k, p)
  where s_suppkey % 5 <> 0 and s_suppkey % 11 <> 0
    and round(23.65::double + s_suppkey / 1000.0::double, 6) <= 23.90""")
def s01(t):
    key = F.col("s_suppkey")

    def sensor(k, name):
        return F.struct((F.when(F.lit(k == 3), None).otherwise(key * 10 + k)).alias("id"),
                        F.struct(F.lit(name).alias("name")).alias("parameter"))

    pages = t.raw("supplier").select(
        F.concat(F.lit("ST"), key.cast("string")).alias("id"),
        F.when(key % 7 != 0, F.col("s_name")).alias("name"),
        F.struct(F.when(key % 5 != 0, F.round(key / 1000.0 + 23.65, 6)).alias("latitude"),
                 F.lit(90.4).alias("longitude")).alias("coordinates"),
        F.when(key % 11 == 0, F.array(sensor(4, "humidity"))).otherwise(F.array(
            sensor(1, "PM2.5"), sensor(2, " pm10 "), sensor(3, "no2"), sensor(4, "humidity"), sensor(5, "SO2"),
        )).alias("sensors"))
    read = landed.read_json(t.spark, _land(pages, "stations"), landed.STATION_JSON)
    table = landed.stations(read, box={"lat_min": 23.65, "lat_max": 23.90, "lon_min": 90.30, "lon_max": 90.50})
    return landed.sensors(table).join(table.drop("sensors"), "station_id").select(
        "station_id", "station_name", "latitude", "longitude", "sensor_id", "parameter")


@query("s02_measurements_json", sql("""
  select station_id, ts, parameter, value,
    case when event_id % 3 = 0 then unit when event_id % 3 = 1 then 'ppm' else 'µg/m³' end as unit
  from readings where value is not null and event_id % 97 <> 0""", "readings"))
def s02(t):
    e, ts = F.col("event_id"), F.col("ts")
    utc = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    local = F.date_format(ts + F.expr("interval 6 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+06:00'")
    records = t.readings.select(
        "station_id", F.concat(F.lit(" "), F.upper("parameter")).alias("parameter_name"), "value",
        F.when(e % 3 == 0, F.struct(F.col("unit").alias("units"))).alias("parameter"),
        F.when(e % 3 == 1, F.lit("ppm")).alias("unit"),
        F.when((e % 2 == 0) & (e % 97 != 0), F.struct(
            F.struct(utc.alias("utc"), F.when(e % 4 == 0, local).alias("local")).alias("datetimeFrom"))).alias("period"),
        F.when((e % 2 == 1) & (e % 97 != 0), F.struct(utc.alias("utc"))).alias("datetime"))
    read = landed.read_json(t.spark, _land(records, "measurements"), landed.MEASUREMENT_JSON)
    return landed.measurements(read).drop("latitude", "longitude")


@query("s03_weather_json", sql("""
  select station_id, ts_hour, temperature, humidity, wind_speed, wind_direction,
    case when day(ts_hour) % 7 = 0 then null else pressure end as pressure from weather""", "weather"))
def s03(t):
    raw = {"temperature": "temperature_2m", "humidity": "relative_humidity_2m", "wind_speed": "wind_speed_10m",
           "wind_direction": "wind_direction_10m", "pressure": "surface_pressure"}
    # One landed record per station and day, so at most 24 entries per array.
    days = t.weather.groupBy("station_id", F.to_date("ts_hour").alias("d")).agg(F.sort_array(F.collect_list(
        F.struct(F.date_format("ts_hour", "yyyy-MM-dd'T'HH:mm").alias("time"), *WEATHER))).alias("h"))
    arrays = F.struct(
        F.col("h.time").alias("time"), *[F.col(f"h.{c}").alias(raw[c]) for c in WEATHER[:-1]],
        F.when(F.dayofmonth("d") % 7 != 0, F.col("h.pressure")).alias(raw["pressure"]))
    path = _land(days.select("station_id", arrays.alias("hourly")), "weather")
    return landed.weather(landed.read_json(t.spark, path, landed.WEATHER_JSON))


def _land_lines(df, name, broken):
    """Records as lines of JSON, cut in the middle where `broken`."""
    path = scratch_path(df.sparkSession, name)
    line = F.to_json(F.struct(*df.columns), out.JSON_TIMES)
    df.select(F.when(broken, F.substring(line, F.lit(1), F.length(line) - 5)).otherwise(line).alias("value")).write.text(path)
    return path


@query("s01_station_rejects", """
  select case when s_suppkey % 10 = 0 then 'malformed' when s_suppkey % 7 = 0 then 'no coordinates' when s_suppkey % 3 = 0 then 'no tracked sensor'
    else 'accepted' end as reason, count(*) as n from supplier group by 1""")
def s01_rejects(t):
    key = F.col("s_suppkey")
    sensor = F.struct(key.alias("id"), F.struct(F.when(key % 3 == 0, "humidity").otherwise("pm25").alias("name")).alias("parameter"))
    pages = t.raw("supplier").select(
        key.cast("string").alias("id"), F.col("s_name").alias("name"),
        F.struct(F.when(key % 7 != 0, 23.7).alias("latitude"), F.lit(90.4).alias("longitude")).alias("coordinates"), F.array(sensor).alias("sensors"))
    path = _land_lines(pages, "station-lines", F.col("id").cast("long") % 10 == 0)
    read = landed.read_checked(t.spark, path, landed.STATION_JSON)
    return landed.rejects(read, landed.station_reasons()).select("reason").unionAll(
        landed.stations(read).select(F.lit("accepted"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("s02_measurement_rejects", sql("""
  select case when event_id % 10 = 0 then 'malformed' when event_id % 97 = 0 then 'no time' when event_id % 89 = 0 then 'unreadable time'
    when value is null then 'no value' else 'accepted' end as reason, count(*) as n from readings group by 1""", "readings"))
def s02_rejects(t):
    e = F.col("event_id")
    utc = F.when(e % 89 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    records = t.readings.select(
        "event_id", "station_id", F.col("parameter").alias("parameter_name"), "value", F.struct(F.when(e % 97 != 0, utc).alias("utc")).alias("datetime"))
    path = _land_lines(records, "measurement-lines", e % 10 == 0)
    read = landed.read_checked(t.spark, path, landed.MEASUREMENT_JSON)
    return landed.rejects(read, landed.measurement_reasons()).select("reason").unionAll(
        landed.measurements(read).select(F.lit("accepted"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("s03_weather_rejects", sql("""
  select case when n % 10 = 0 then 'malformed' when n % 7 = 0 then 'no hours' else 'accepted' end as reason, count(*) as n
  from (select count(*) as n from weather group by station_id, ts_hour::date) group by 1""", "weather"))
def s03_rejects(t):
    days = t.weather.groupBy("station_id", F.to_date("ts_hour").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.date_format("ts_hour", "yyyy-MM-dd'T'HH:mm"))).alias("time"))
    hours = F.when(F.col("n") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("time"))
    records = days.select("n", "d", "station_id", F.struct(hours.alias("time")).alias("hourly"))
    path = _land_lines(records, "weather-lines", F.col("n") % 10 == 0)
    read = landed.read_checked(t.spark, path, landed.WEATHER_JSON)
    whole = read.where(F.col(landed.CORRUPT).isNull() & (F.size("hourly.time") > 0)).select(F.lit("accepted"))
    return landed.rejects(read, landed.weather_reasons()).select("reason").unionAll(whole).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("s04_window_clamp", sql(f"""
  select {READING_COLS} from readings
  where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-21'""", "readings"))
def s04(t):
    return landed.within_days(t.readings, "2024-01-05", "2024-01-20")


@query("s05_json_records", sql(f"select {READING_COLS} from readings", "readings"))
def s05(t):
    df = t.readings
    return landed.read_json(t.spark, _land(df, "records"), df.schema)


@query("s06_typed_frame", sql("""
  select station_id, ts, parameter, value, unit, null::double as latitude, null::double as longitude
  from readings""", "readings"))
def s06(t):
    return landed.empty_readings(t.spark).unionByName(normalize(t.readings, READING))


@query("s07_text_station_scan", sql("""
  select lpad((o_custkey % 12)::varchar, 3, '0') as station_id, o_orderkey, o_totalprice from orders"""))
def s07(t):
    df = t.raw("orders").select(
        F.lpad((F.col("o_custkey") % 12).cast("string"), 3, "0").alias("station_id"), "o_orderkey", "o_totalprice")
    path = scratch_path(t.spark, "by-station")
    df.write.partitionBy("station_id").parquet(path)
    schema = "o_orderkey bigint, o_totalprice double, station_id string"
    return out.read_parquet(t.spark, path, T.StructType.fromDDL(schema)).select(
        "station_id", "o_orderkey", "o_totalprice")


@query("s08_partition_station_month", sql("""
  select station_id, ts, pm25, ts::date as date, year(ts)::varchar as year, month(ts)::varchar as month
  from wide_s""", "wide_s"), rounds={"pm25": 6})
def s08(t):
    path = scratch_path(t.spark, "station-month")
    out.write_by_station_month(t.wide_s.select("station_id", "ts", "pm25"), path)
    schema = "ts timestamp_ntz, pm25 double, date date, station_id string, year string, month string"
    return out.read_parquet(t.spark, path, T.StructType.fromDDL(schema)).select(
        "station_id", "ts", "pm25", "date", "year", "month")


@query("s08_replaced_days", sql("""
  select station_id, ts, case when ts::date between date '2024-01-10' and date '2024-01-12' then pm25 + 1 else pm25 end as pm25, year(ts) as year,
    month(ts) as month from wide where ts < timestamp '2024-01-21'""", "wide"), rounds={"pm25": 6})
def s08_days(t):
    """A store of twenty days, three of which are written again with other values, twice."""
    path = scratch_path(t.spark, "station-months")
    rows = t.wide.select("station_id", "ts", "pm25")
    out.replace_days(landed.within_days(rows, "2024-01-01", "2024-01-20"), path)
    for _ in range(2):
        out.replace_days(landed.within_days(rows, "2024-01-10", "2024-01-12").withColumn("pm25", F.col("pm25") + 1), path)
    return out.read_parquet(t.spark, path, T.StructType.fromDDL(
        "station_id string, ts timestamp_ntz, pm25 double, year int, month int")).select("station_id", "ts", "pm25", "year", "month")


@query("s09_partition_month", sql("""
  select year(ts) as year, month(ts) as month, count(*) as n, count(pm25) as n_pm25 from wide_s
  where month(ts) = 4 group by 1, 2""", "wide_s"))
def s09(t):
    path = scratch_path(t.spark, "month")
    out.write_by_month(t.wide_s, path)
    schema = "station_id string, ts timestamp_ntz, pm25 double, year int, month int"
    stored = out.read_parquet(t.spark, path, T.StructType.fromDDL(schema))
    # The filter names a partition folder, so the other months are never opened.
    return stored.where(F.col("month") == 4).groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.count("pm25").alias("n_pm25"))


@query("s10_plain_parquet", sql("select station_id, ts_hour, temperature, pressure from weather", "weather"))
def s10(t):
    path = scratch_path(t.spark, "plain")
    out.write_parquet(t.weather.select("station_id", "ts_hour", "temperature", "pressure"), path)
    return t.spark.read.parquet(path)


@query("s11_csv_sink", sql("""
  select station_id, avg(pm25) as mean_pm25, count(*) as n_readings from bulk
  where pm25 is not null group by 1""", "bulk"), rounds={"mean_pm25": 6})
def s11(t):
    path = scratch_path(t.spark, "csv")
    out.write_csv(t.bulk.where("pm25 is not null").groupBy("station_id").agg(
        F.avg("pm25").alias("mean_pm25"), F.count(F.lit(1)).alias("n_readings")), path)
    return out.read_csv(t.spark, path, T.StructType.fromDDL("station_id string, mean_pm25 double, n_readings bigint"))


@query("s12_csv_or_empty", "select s_suppkey, s_name, s_acctbal from supplier")
def s12(t):
    schema = T.StructType.fromDDL("s_suppkey bigint, s_name string, s_acctbal double")
    path = scratch_path(t.spark, "suppliers")
    out.write_csv(t.raw("supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    absent = out.read_csv(t.spark, scratch_path(t.spark, "absent"), schema)
    return out.read_csv(t.spark, path, schema).unionByName(absent)


@query("s13_view", sql("""
  select station_id, count(*) as n from wide where pm25 > 20 group by 1""", "wide"))
def s13(t):
    name = out.as_view(t.wide, "hazegrid_wide")
    return t.spark.sql(f"select station_id, count(*) as n from {name} where pm25 > 20 group by station_id")


@query("s14_export_view", sql("""
  select w.station_id, s.station_name, s.station_name as name, ts, hour(ts) as hour, month(ts) as month,
    case when month(ts) in (12, 1, 2) then 'Winter' when month(ts) in (3, 4, 5) then 'Pre-Monsoon'
         when month(ts) in (6, 7, 8, 9) then 'Monsoon' else 'Post-Monsoon' end as season, pm25, pm10
  from wide_s w left join stations s using (station_id)""", "wide_s", "stations"), rounds={"pm25": 6, "pm10": 6})
def s14(t):
    named = t.wide_s.join(t.stations.select("station_id", "station_name"), "station_id", "left")
    path = scratch_path(t.spark, "export")
    out.write_parquet(out.export_view(named).select(
        "station_id", "station_name", "name", "ts", "hour", "month", "season", "pm25", "pm10"), path)
    return t.spark.read.parquet(path)


@query("s15_metadata_json", sql("""
  select 'hourly' as table_name, count(*) as n_rows, count(distinct station_id) as stations from wide""", "wide"))
def s15(t):
    facts = t.wide.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("station_id").alias("s")).first()
    path = scratch_path(t.spark, "metadata")
    out.write_metadata(t.spark, path, table_name="hourly", n_rows=facts.n, stations=facts.s)
    return landed.read_json(t.spark, path, "table_name string, n_rows bigint, stations bigint")


@query("s17_provenance_flags", sql("""
  select avg((temperature is null)::int) * 100 as is_synthetic_weather_pct,
    avg((population_catchment is null)::int) * 100 as is_synthetic_population_pct
  from wide w left join weather h on h.station_id = w.station_id and h.ts_hour = w.ts
  left join population p on p.station_id = w.station_id""", "wide", "weather", "population"),
    rounds={"is_synthetic_weather_pct": 6, "is_synthetic_population_pct": 6})
def s17(t):
    measured = joins.join_on(joins.with_weather(t.wide, t.weather), t.population.select("station_id", "population_catchment"), ["station_id"])
    flagged = out.with_provenance(
        measured, is_synthetic_weather=F.col("temperature").isNull(), is_synthetic_population=F.col("population_catchment").isNull())
    return profile.flagged_share(flagged, ["is_synthetic_weather", "is_synthetic_population"])


@query("s18_absent_weather", sql("""
  select station_id, ts as ts_hour, null::double as temperature, null::double as humidity,
    null::double as wind_speed, null::double as wind_direction, null::double as pressure, pm25
  from wide""", "wide"), rounds={"pm25": 6})
def s18(t):
    return normalize(t.wide.withColumnRenamed("ts", "ts_hour"), WEATHER_HOURLY, keep_extra=True).select(
        *WEATHER_HOURLY.fieldNames(), "pm25")


