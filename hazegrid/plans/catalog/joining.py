"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.functions.calendar import season
from hazegrid.functions.text import clean_name
from hazegrid.operators import cleaning, forecast, health as H, joins, profile, spatial
from hazegrid.operators.lookup import missing_keys
from hazegrid.plans.catalog.registry import query
from hazegrid.plans.tables import KEYWORDS, sql
from hazegrid.schema import CLIP_K, POLLUTANTS, SEASONS, WEATHER

c = F.col
SIX = {p: 6 for p in POLLUTANTS}

# Every station of the supplier table, spread over the grid; several share a position.
SITES_SQL = """select 'S' || s_suppkey::varchar as station_id, s_name as station_name,
    23.60::double + (s_suppkey * 13 % 37) / 100.0::double as latitude,
    90.25::double + (s_suppkey * 29 % 31) / 100.0::double as longitude from supplier"""
PAIRS_KM = """2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - latitude) / 2), 2)
    + cos(radians(latitude)) * cos(radians(lat)) * pow(sin(radians(lon - longitude) / 2), 2))))"""


def sites(t):
    k = c("s_suppkey")
    return t.raw("supplier").select(
        F.concat(F.lit("S"), k.cast("string")).alias("station_id"), c("s_name").alias("station_name"),
        (k * 13 % 37 / 100.0 + 23.60).alias("latitude"), (k * 29 % 31 / 100.0 + 90.25).alias("longitude"))


@query("j01_station_weather", sql("""
  select w.station_id, ts, pm25, temperature, humidity, wind_speed, wind_direction, pressure
  from wide w left join weather h on h.station_id = w.station_id and h.ts_hour = date_trunc('hour', w.ts)""",
    "wide", "weather"), rounds={"pm25": 6})
def j01(t):
    return joins.with_weather(t.wide, t.weather).select("station_id", "ts", "pm25", *WEATHER)


@query("j02_city_weather", sql("""
  select w.station_id, ts, pm25, h.station_id as weather_from, temperature from wide w left join (
    select * from weather qualify row_number() over (partition by ts_hour order by station_id) = 1) h
  on h.ts_hour = w.ts""", "wide", "weather"), rounds={"pm25": 6})
def j02(t):
    city = t.weather.withColumnRenamed("station_id", "weather_from").select("ts_hour", "weather_from", *WEATHER)
    return joins.with_city_weather(t.wide, city).select("station_id", "ts", "pm25", "weather_from", "temperature")


@query("j03_population", sql("select station_id, ts, population_catchment from peopled", "peopled"))
def j03(t):
    return t.peopled.select("station_id", "ts", "population_catchment")


@query("j04_station_metadata", sql("""
  select event_id, station_id, station_name, latitude, longitude from readings left join stations using (station_id)""",
    "readings", "stations"))
def j04(t):
    return joins.with_station(t.readings, t.stations).select(
        "event_id", "station_id", "station_name", "latitude", "longitude")


MED = ", ".join(f"quantile_disc({p}, 0.5) as m_{p}" for p in POLLUTANTS)


@query("j05_hour_median_fallback", sql(f"""
  select w.station_id, ts, {', '.join(f'coalesce({p}, m_{p}) as {p}' for p in POLLUTANTS)} from wide w
  left join (select station_id, hour(ts) as h, {MED} from wide group by 1, 2) m
  on m.station_id = w.station_id and m.h = hour(w.ts)""", "wide"), rounds=SIX)
def j05(t):
    return cleaning.fill_from_hour_medians(t.wide, POLLUTANTS)


@query("j06_day_median_fallback", sql("""
  select r.event_id, coalesce(value, m) as value from readings r left join (
    select station_id, parameter, ts::date as d, quantile_disc(value, 0.5) as m from readings
    where value is not null group by 1, 2, 3) q
  on q.station_id = r.station_id and q.parameter = r.parameter and q.d = r.ts::date""", "readings"))
def j06(t):
    filled = cleaning.fill_from_day_medians(t.readings, "value", cleaning.day_medians(t.readings, "value"))
    return filled.select("event_id", "value")


@query("j07_station_fences", sql("""
  select b.station_id, ts, pm25, q1 - 1.5 * (q3 - q1) as lower_pm25, q3 + 1.5 * (q3 - q1) as upper_pm25 from bulk b
  left join (select station_id, quantile_disc(pm25, 0.25) as q1, quantile_disc(pm25, 0.75) as q3 from bulk
    where pm25 is not null group by 1) q using (station_id)""", "bulk"),
    rounds={"pm25": 6, "lower_pm25": 6, "upper_pm25": 6})
def j07(t):
    fences = cleaning.quartile_fences(t.bulk, ["pm25"], CLIP_K).select("station_id", "lower_pm25", "upper_pm25")
    return joins.join_on(t.bulk.select("station_id", "ts", "pm25"), fences, ["station_id"])


@query("j08_reading_fences", sql("""
  select event_id, value, q1 - 3.0 * (q3 - q1) as lower, q3 + 3.0 * (q3 - q1) as upper from readings r
  left join (select station_id, parameter, quantile_disc(value, 0.25) as q1, quantile_disc(value, 0.75) as q3
    from readings where value is not null group by 1, 2) q using (station_id, parameter)""", "readings"),
    rounds={"lower": 6, "upper": 6})
def j08(t):
    fences = cleaning.reading_fences(t.readings).select("station_id", "parameter", "lower", "upper")
    return joins.join_on(t.readings, fences, ["station_id", "parameter"]).select("event_id", "value", "lower", "upper")


@query("j09_keyword_area", """
  select 'P' || p_partkey::varchar as station_id, case when p_partkey = 7 then 'Known' else
      coalesce(area, 'estimated (Dhaka metro average)') end as catchment_area_name,
    case when p_partkey = 7 then 123456 else floor(coalesce(density, 23000) * pi() * 9) end::bigint as population_catchment
  from part left join (select p_partkey as k, area, density from part, (values ('red', 1, 'Red', 42000),
      ('ring', 2, 'Ring', 38000), ('bolt', 3, 'Bolt', 35000), ('gizmo', 4, 'Gizmo', 30000)) v(word, place, area, density)
    where contains(lower(p_name), word) qualify row_number() over (partition by p_partkey order by place) = 1) m
  on m.k = p_partkey""")
def j09(t):
    named = t.raw("part").select(
        F.concat(F.lit("P"), c("p_partkey").cast("string")).alias("station_id"), F.upper("p_name").alias("station_name"))
    table = t.spark.createDataFrame([(*k, i) for i, k in enumerate(KEYWORDS)], "keyword string, label string, amount long, place long")
    return joins.catchment_from_table(named, table, known=[("P7", "Known", 123456)])


@query("j09_many_keywords", """
  select s_suppkey, min_by(l_orderkey, (l_orderkey, word)) as place, min_by(word, (l_orderkey, word)) as keyword
  from (select s_suppkey, lower(s_name) as name from supplier) s
  join (select min(l_orderkey) as l_orderkey, l_suppkey::varchar as word from lineitem group by l_suppkey) k on contains(name, word)
  group by 1""")
def j09_many(t):
    """Every supplier number that occurs in the line items as a keyword, looked for in all supplier names."""
    key = c("l_suppkey").cast("string")
    words = t.raw("lineitem").groupBy(key.alias("keyword")).agg(F.min("l_orderkey").alias("place")).withColumns(
        {"label": F.lit(""), "amount": F.lit(0)})
    names = t.raw("supplier").select("s_suppkey", "s_name")
    found = joins.first_keywords(names, "s_name", words)
    return names.join(found, F.lower("s_name") == c("_text")).select("s_suppkey", c("_first.place").alias("place"), c("_first.keyword").alias("keyword"))


@query("j10_population_square", sql(f"""
  select station_id, coalesce(floor(sum(pop)), 650309)::bigint as population_catchment, count(pop) as n_cells
  from ({SITES_SQL}) s left join (select lat, lon, sum(pop) as pop from pop_grid where pop > 0 and pop < 1e8
    group by 1, 2) g on abs(lat - latitude) <= 3.0 / 111.0 and abs(lon - longitude) <= 3.0 / 111.0
  group by 1""", "pop_grid"))
def j10(t):
    return spatial.population_in_square(sites(t), t.pop_grid, 3.0, default=650_309)


@query("j11_population_circle", sql(f"""
  select station_id, floor(sum(pop))::bigint as population_catchment, count(pop) as n_cells from ({SITES_SQL}) s
  left join (select lat, lon, sum(pop) as pop from pop_grid where pop > 0 and pop < 1e8 group by 1, 2) g
  on {PAIRS_KM} <= 4.0 group by 1""", "pop_grid"))
def j11(t):
    return spatial.population_in_circle(sites(t), t.pop_grid, 4.0)


@query("j12_nearest_weather_point", sql(f"""
  select station_id, min_by(cell_id, (round({PAIRS_KM}, 6), cell_id)) as cell_id,
    round(min({PAIRS_KM}), 6) as distance_km
  from ({SITES_SQL}) s, (select lat, lon, min(cell_id) as cell_id from pop_grid group by 1, 2) g
  group by 1""", "pop_grid"), rounds={"distance_km": 5})
def j12(t):
    points = t.pop_grid.select(
        "cell_id", c("lat").alias("latitude"), c("lon").alias("longitude"))
    return spatial.nearest_point(sites(t), points, "cell_id")


@query("j13_station_by_crf", sql("""
  select station_id, mean_pm25, crf, beta, crf_label, 'pm25' as pollutant from means, crf""", "means", "crf"),
    rounds={"mean_pm25": 6})
def j13(t):
    return joins.per_crf(H.station_means(t.peopled)).select(
        "station_id", "mean_pm25", "crf", "beta", "crf_label", "pollutant")


@query("j14_burden_onto_ranking", sql("""
  select r.station_id, season, health_impact_score, coalesce(d, catchment_pop * 0.0018) as attrib_deaths from ranking r
  left join (select station_id, avg(attrib_deaths) as d from burden where crf = 'pm25_annual'
    group by 1) b using (station_id)""", "ranking", "burden"), rounds={"attrib_deaths": 4})
def j14(t):
    suffix = F.lit(" | Dhaka | Smart Air Bangladesh")
    ranked = H.impact_ranking(t.peopled).withColumn("clean_name", clean_name(F.concat("station_id", suffix)))
    table = H.burden_table(H.station_means(t.peopled)).where(c("crf") == "pm25_annual")
    deaths = table.groupBy("station_id").agg(F.avg("attrib_deaths").alias("attrib_deaths")).withColumnRenamed(
        "station_id", "clean_name")
    return joins.fallback_join(ranked, deaths, "clean_name", "attrib_deaths", c("catchment_pop") * 0.0018).select(
        "station_id", "season", "health_impact_score", "attrib_deaths")


@query("j15_observed_overlay", sql("""
  select b.ts, coalesce(o.pm25, b.pm25) as pm25, n as n_common
  from (select ts_hour as ts, avg(humidity) as pm25 from weather group by 1) b
  left join (select ts, avg(pm25) as pm25 from wide group by 1 having avg(pm25) is not null) o using (ts)
  cross join (select count(*) as n from (select ts_hour as ts from weather group by 1)
    join (select ts from wide group by 1 having avg(pm25) is not null) using (ts))""", "weather", "wide"),
    rounds={"pm25": 6})
def j15(t):
    base = t.weather.groupBy(c("ts_hour").alias("ts")).agg(F.avg("humidity").alias("pm25"))
    return joins.overlay(base, profile.hourly_city_mean(t.wide), "ts", "pm25")


@query("j16_hourly_spine", sql("""
  select s.station_id, s.ts, pm25 from (select station_id, unnest(generate_series(max(ts) - interval 71 hours, max(ts),
      interval 1 hour)) as ts from wide group by 1) s left join wide w on w.station_id = s.station_id and w.ts = s.ts""",
    "wide"), rounds={"pm25": 6})
def j16(t):
    return joins.on_spine(t.wide.select("station_id", "ts", "pm25"), 72)


@query("j17_season_domain", sql("""
  select d.season, d.o as ordinal, m.pm25 from (values ('Winter', 0::bigint), ('Pre-Monsoon', 1), ('Monsoon', 2),
    ('Post-Monsoon', 3)) d(season, o) left join (select case when month(ts) in (12, 1, 2) then 'Winter'
      when month(ts) in (3, 4, 5) then 'Pre-Monsoon' when month(ts) in (6, 7, 8, 9) then 'Monsoon'
      else 'Post-Monsoon' end as season, avg(pm25) as pm25 from wide_s group by 1) m
  on m.season = d.season""", "wide_s"), rounds={"pm25": 6})
def j17(t):
    means = t.wide_s.groupBy(season(F.month("ts")).alias("season")).agg(
        F.avg("pm25").alias("pm25"))
    return joins.on_domain(means, "season", SEASONS)


@query("j18_dropped_keys", sql("""
  select distinct station_id, ts from wide where (station_id, ts) not in (select (station_id, ts_hour) from weather)""",
    "wide", "weather"))
def j18(t):
    return missing_keys(t.wide, t.weather.withColumnRenamed("ts_hour", "ts"), ["station_id", "ts"])


SCENARIOS = [("cool calm", 12.0, 85.0, 2.0), ("mild", 25.0, 60.0, 8.0), ("hot windy", 38.0, 40.0, 30.0)]


@query("j19_what_if", sql("""
  select station_id, ts, scenario, round(least(greatest(360 + least(greatest(sin((hour(ts) - 6) * pi() / 12), -0.75), 1.0)
      * 360 * 0.70 + greatest((temp - 20.0) * 12.0, 0) + greatest(wind * 15.0, 0), 120.0), 2700.0), 1) as blh_m
  from wide, (values ('cool calm', 12.0::double, 2.0::double), ('mild', 25, 8), ('hot windy', 38, 30)) v(scenario, temp, wind)
  """, "wide"))
def j19(t):
    return forecast.what_if(t.wide, SCENARIOS).select("station_id", "ts", "scenario", "blh_m")


@query("j20_crf_alignment", sql("""
  select station_id, coalesce(max(attrib_deaths) filter (where crf = 'pm25_long_term'), 0) as pm25_long_term,
    coalesce(max(attrib_deaths) filter (where crf = 'pm25_annual'), 0) as pm25_annual
  from burden group by 1""", "burden"), rounds={"pm25_long_term": 3, "pm25_annual": 3})
def j20(t):
    table = H.burden_table(H.station_means(t.peopled))
    return H.burden_side_by_side(table, "attrib_deaths", missing=0.0)


