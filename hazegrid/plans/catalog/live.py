"""Streams over the events table, and the same transformations on the batch table.

A stream emits a window once the watermark has passed its end. The events arrive as one
file, so all of them are seen before the watermark moves and the emitted set is known.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.plans.catalog.expressions import CAT_SQL, CEIL_SQL
from hazegrid.plans.catalog.registry import query
from hazegrid.plans.tables import sql
from hazegrid.session import scratch_path
from hazegrid.streaming import live

c = F.col


def stream(t):
    schema = t.raw("events").schema
    events = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parquet*")
    return live.timed(t.readings_from(events))


def batch(t):
    return live.timed(t.readings)


def plain(df, *names):
    """Event times back to TIMESTAMP_NTZ for comparison."""
    return df.withColumns({n: c(n).cast("timestamp_ntz") for n in names})


LATEST = """select station_id, max(ts) as ts, max_by(value, ts) as value from readings
  where parameter = 'pm25' and value between 1 and 900 group by 1"""
HOURLY = """select station_id, parameter, date_trunc('hour', ts) as hour_start, avg(value) as mean_value, count(value) as n
  from readings group by 1, 2, 3"""
DAILY = """select station_id, parameter, date_trunc('hour', ts) + to_hours(k) as window_end, avg(value) as mean_value,
  count(value) as n from readings, (select unnest(range(1, 25))::int as k) group by 1, 2, 3"""
CLOSED = "(select max(ts) - interval 10 minutes from readings)"
# `hourly_aqi` keeps PM2.5 before it sets the watermark, so only those readings move it.
CLOSED_PM25 = "(select max(ts) - interval 10 minutes from readings where parameter = 'pm25')"
AQI_SQL = f"""select *, {CEIL_SQL} as aqi, {CAT_SQL.format(x=CEIL_SQL)} as aqi_cat from (
  select *, mean_value as pm25 from ({HOURLY}) where parameter = 'pm25')"""


@query("r01_latest_valid", sql(LATEST, "readings"))
def r01(t):
    out = live.run_updates(live.latest_valid(stream(t)), scratch_path(t.spark, "latest"), ["station_id"])
    return plain(out, "ts")


@query("r01_latest_valid_batch", sql(LATEST, "readings"))
def r01_batch(t):
    return plain(live.latest_valid(batch(t)), "ts")


@query("r02_hourly_means", sql(f"select * from ({HOURLY}) where hour_start + interval 1 hour <= {CLOSED}", "readings"),
       rounds={"mean_value": 6})
def r02(t):
    return plain(live.run_available(live.hourly_means(stream(t)), scratch_path(t.spark, "hourly")), "hour_start")


@query("r02_hourly_means_batch", sql(HOURLY, "readings"), rounds={"mean_value": 6})
def r02_batch(t):
    return plain(live.hourly_means(batch(t)), "hour_start")


@query("r03_daily_means_hourly", sql(f"select * from ({DAILY}) where window_end <= {CLOSED}", "readings"),
       rounds={"mean_value": 6})
def r03(t):
    return plain(live.run_available(live.daily_means_hourly(stream(t)), scratch_path(t.spark, "daily")), "window_end")


@query("r03_daily_means_hourly_batch", sql(DAILY, "readings"), rounds={"mean_value": 6})
def r03_batch(t):
    return plain(live.daily_means_hourly(batch(t)), "window_end")


@query("r04_without_repeats", sql("select event_id, station_id, ts, parameter, value, unit from readings", "readings"))
def r04(t):
    # Every event is sent twice, the second copy in another row of the same file.
    twice = stream(t).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return plain(live.run_available(live.without_repeats(twice), scratch_path(t.spark, "unique")), "ts")


@query("r05_hourly_aqi", sql(
    f"select * exclude (pm25) from ({AQI_SQL}) where hour_start + interval 1 hour <= {CLOSED_PM25}", "readings"),
    rounds={"mean_value": 6})
def r05(t):
    return plain(live.run_available(live.hourly_aqi(stream(t)), scratch_path(t.spark, "aqi")), "hour_start")


@query("r05_hourly_aqi_batch", sql(f"select * exclude (pm25) from ({AQI_SQL})", "readings"), rounds={"mean_value": 6})
def r05_batch(t):
    return plain(live.hourly_aqi(batch(t)), "hour_start")
