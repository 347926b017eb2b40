"""Projections, filters and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.functions import aqi, atmosphere, health, signatures, text, units
from hazegrid.functions.calendar import day_type, parse_utc, season, season_code, with_calendar
from hazegrid.functions.geo import inside_box
from hazegrid.operators import cleaning, health as H, joins
from hazegrid.operators.signatures import dominant_sources, by_station_season
from hazegrid.plans.catalog.registry import query
from hazegrid.plans.tables import sql, station_of
from hazegrid.schema import DEFAULT_CATCHMENT_COARSE, SOURCES, WEATHER_RENAME

c = F.col

SEASON_SQL = """case when month(ts) in (12, 1, 2) then 'Winter' when month(ts) in (3, 4, 5) then 'Pre-Monsoon'
  when month(ts) in (6, 7, 8, 9) then 'Monsoon' else 'Post-Monsoon' end"""


def strict_sql(col: str, bands: list) -> str:
    """Index with seven bands and nulls in the gaps."""
    arms = " ".join(
        f"when {col} between {a} and {b} then {lo} + ({hi} - {lo}) / ({b} - {a})::double * ({col} - {a})"
        for a, b, lo, hi in bands)
    return f"(case {arms} when {col} > {bands[-1][1]} then 500 end)::double"


# Breakpoints written out a second time, so that the check does not share the code's table.
PM25_BANDS = [(0.0, 12.0, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150), (55.5, 150.4, 151, 200),
              (150.5, 250.4, 201, 300), (250.5, 350.4, 301, 400), (350.5, 500.4, 401, 500)]
PM10_BANDS = [(0, 54, 0, 50), (55, 154, 51, 100), (155, 254, 101, 150), (255, 354, 151, 200),
              (355, 424, 201, 300), (425, 504, 301, 400), (505, 604, 401, 500)]
CAT_SQL = """case when {x} is null then 'Unknown' when {x} <= 50 then 'Good' when {x} <= 100 then 'Moderate'
  when {x} <= 150 then 'Unhealthy for Sensitive Groups' when {x} <= 200 then 'Unhealthy'
  when {x} <= 300 then 'Very Unhealthy' else 'Hazardous' end"""
CEIL_SQL = """(case when pm25 is null then null when greatest(pm25, 0) <= 12.0 then round_even(50 / 12.0::double * greatest(pm25, 0), 0)
  when pm25 <= 35.4 then round_even(49 / (35.4 - 12.1)::double * (pm25 - 12.1) + 51, 0)
  when pm25 <= 55.4 then round_even(49 / (55.4 - 35.5)::double * (pm25 - 35.5) + 101, 0)
  when pm25 <= 150.4 then round_even(49 / (150.4 - 55.5)::double * (pm25 - 55.5) + 151, 0)
  when pm25 <= 250.4 then round_even(99 / (250.4 - 150.5)::double * (pm25 - 150.5) + 201, 0)
  else least(999, round_even(199 / (500.4 - 250.5)::double * (pm25 - 250.5) + 301, 0)) end)::bigint"""
LIVE_SQL = """(case when pm25 < 0 then null when pm25 > 500.4 then 500
  when pm25 between 0 and 12.0 then round_even(50 / 12.0::double * pm25, 0)
  when pm25 between 12.1 and 35.4 then round_even(49 / (35.4 - 12.1)::double * (pm25 - 12.1) + 51, 0)
  when pm25 between 35.5 and 55.4 then round_even(49 / (55.4 - 35.5)::double * (pm25 - 35.5) + 101, 0)
  when pm25 between 55.5 and 150.4 then round_even(49 / (150.4 - 55.5)::double * (pm25 - 55.5) + 151, 0)
  when pm25 between 150.5 and 250.4 then round_even(99 / (250.4 - 150.5)::double * (pm25 - 150.5) + 201, 0)
  when pm25 between 250.5 and 500.4 then round_even(199 / (500.4 - 250.5)::double * (pm25 - 250.5) + 301, 0) end)::bigint"""
# An odd term moves readings into the gaps between bands and below zero.
SHIFTED = "select l_orderkey, l_linenumber, ts, pm25 + case when l_orderkey % 3 = 0 then 0.05 when l_orderkey % 31 = 0 " \
    "then -100 else 0 end as pm25 from bulk_raw"


def shifted(t):
    k = c("l_orderkey")
    return t.bulk_raw.select("l_orderkey", "l_linenumber", "ts", (
        c("pm25") + F.when(k % 3 == 0, 0.05).when(k % 31 == 0, -100.0).otherwise(0.0)).alias("pm25"))


@query("p01_time_features", sql("""
  select station_id, ts, hour(ts) as hour, dayofweek(ts) + 1 as dow, day(ts) as day, month(ts) as month,
    year(ts) as year, ts::date as date from bulk""", "bulk"))
def p01(t):
    return with_calendar(t.bulk.select("station_id", "ts")).drop("season", "season_code")


@query("p02_season", sql(f"""
  select station_id, ts, {SEASON_SQL} as season,
    case when month(ts) in (12, 1, 2) then 0 when month(ts) in (3, 4, 5) then 1
         when month(ts) in (6, 7, 8, 9) then 2 else 3 end::bigint as season_code from bulk""", "bulk"))
def p02(t):
    name = season(F.month("ts"))
    return t.bulk.select("station_id", "ts", name.alias("season"), season_code(name).alias("season_code"))


@query("p03_unit_standardise", sql("""
  select event_id, parameter, case when unit in ('ppb', 'ppm') then
      case when unit = 'ppb' then value / 1000.0 else value end *
        case parameter when 'no2' then 1882.0 when 'o3' then 1961.0 when 'so2' then 2619.0 when 'co' then 1145.0
             else 1.0 end
    else value end as value, 'µg/m³' as unit from readings""", "readings"), rounds={"value": 6})
def p03(t):
    value = units.to_mass_units(c("value"), c("unit"), c("parameter"))
    return t.readings.select("event_id", "parameter", value.alias("value"), F.lit(units.TARGET_UNIT).alias("unit"))


@query("p04_physical_range", sql("""
  select event_id, parameter, case when v < 0 or v > case parameter when 'pm25' then 1500 when 'pm10' then 3000
      when 'no2' then 500 when 'o3' then 400 when 'so2' then 500 when 'co' then 100 end then null else v end as value
  from (select event_id, parameter, case when unit in ('ppb', 'ppm') then
      case when unit = 'ppb' then value / 1000.0 else value end *
        case parameter when 'no2' then 1882.0 when 'so2' then 2619.0 when 'co' then 1145.0 else 1.0 end
    else case when event_id % 50 = 0 then -value else value end end as v from readings)""", "readings"),
    rounds={"value": 6})
def p04(t):
    flip = F.when((c("event_id") % 50 == 0) & (c("unit") == "ug/m3"), -c("value")).otherwise(c("value"))
    return cleaning.standardise(t.readings.withColumn("value", flip)).select("event_id", "parameter", "value")


@query("p05_enforce_schema", sql("""
  select station_id, null::varchar as station_name, null::double as latitude, null::double as longitude, ts,
    pm25::float as pm25, pm10::float as pm10, no2::float as no2, o3::float as o3,
    so2::float as so2, co::float as co, null::double as temperature, null::double as humidity,
    null::double as wind_speed, null::double as wind_direction, null::double as pressure, population_catchment,
    ts::date as date, year(ts) as year, month(ts) as month from peopled""", "peopled"))
def p05(t):
    return cleaning.enforce_schema(t.peopled.withColumn("_left_over", F.lit(1)))


@query("p06_coordinate_fallback", sql("""
  select event_id, coalesce(case when event_id % 2 = 0 then value end, latitude) as latitude,
    coalesce(case when event_id % 4 = 0 then value end, longitude) as longitude, station_name
  from readings left join stations using (station_id)""", "readings", "stations"))
def p06(t):
    own = t.readings.select(
        "event_id", "station_id", F.when(c("event_id") % 2 == 0, c("value")).alias("latitude"),
        F.when(c("event_id") % 4 == 0, c("value")).alias("longitude"))
    return joins.with_station(own, t.stations).select("event_id", "latitude", "longitude", "station_name")


@query("p07_bounding_box", sql("""
  select cell_id, lat, lon from pop_grid where lat between 23.65 and 23.90 and lon between 90.30 and 90.50""",
    "pop_grid"))
def p07(t):
    return t.pop_grid.where(inside_box(c("lat"), c("lon"))).select("cell_id", "lat", "lon")


@query("p08_parameter_names", sql("""
  select event_id, replace(parameter, 'pm25', 'pm25') as parameter from readings
  where parameter in ('pm25', 'pm10', 'no2', 'o3', 'so2', 'co') and event_id % 13 <> 0""", "readings"))
def p08(t):
    raw = F.concat(F.lit(" "), F.upper(F.replace("parameter", F.lit("pm25"), F.lit("pm2.5"))), F.lit(" "))
    odd = F.when(c("event_id") % 13 == 0, F.lit("Humidity")).otherwise(raw)
    named = t.readings.select("event_id", units.parameter_name(odd).alias("parameter"))
    return named.where(units.is_tracked(c("parameter")))


@query("p09_parse_timestamp", sql("""
  select event_id, case when event_id % 7 = 0 then null else date_trunc('second', ts) end as ts from readings""",
    "readings"))
def p09(t):
    stamp = F.when(c("event_id") % 7 == 0, F.lit("not a time")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.readings.select("event_id", parse_utc(stamp).alias("ts"))


@query("p10_to_number", sql("""
  select event_id, case when event_id % 9 = 0 then null else value end as value from readings""", "readings"))
def p10(t):
    raw = F.when(c("event_id") % 9 == 0, F.lit("n/a")).otherwise(c("value").cast("string"))
    return t.readings.select("event_id", units.to_number(raw).alias("value"))


@query("p11_exposure_score", sql("""
  select station_id, ts, pm25 * population_catchment as exposure_score from peopled""", "peopled"),
    rounds={"exposure_score": 2})
def p11(t):
    return t.peopled.select("station_id", "ts", health.exposure(c("pm25"), c("population_catchment")).alias("exposure_score"))


@query("p12_weighted_exposure", sql("""
  select station_id, ts, pm25 * population_catchment / 1e6 as pwe_pm25, pm10 * population_catchment / 1e6 as pwe_pm10
  from peopled""", "peopled"), rounds={"pwe_pm25": 6, "pwe_pm10": 6})
def p12(t):
    return t.peopled.select("station_id", "ts", *[
        health.exposure_millions(c(p), c("population_catchment")).alias(f"pwe_{p}") for p in ("pm25", "pm10")])


@query("p13_aqi_strict", sql(f"""
  select l_orderkey, l_linenumber::bigint as l_linenumber, ts, {strict_sql('pm25', PM25_BANDS)} as aqi_pm25
  from ({SHIFTED})""", "bulk_raw"), rounds={"aqi_pm25": 6})
def p13(t):
    return shifted(t).select("l_orderkey", "l_linenumber", "ts", aqi.index_strict(c("pm25")).alias("aqi_pm25"))


@query("p13_aqi_strict_pm10", sql(f"""
  select station_id, ts, {strict_sql('pm10', PM10_BANDS)} as aqi_pm10 from bulk""", "bulk"), rounds={"aqi_pm10": 6})
def p13b(t):
    return t.bulk.select("station_id", "ts", aqi.index_strict(c("pm10"), "pm10").alias("aqi_pm10"))


@query("p14_aqi_ceiling", sql(f"""
  select l_orderkey, l_linenumber::bigint as l_linenumber, ts, {CEIL_SQL} as aqi from ({SHIFTED})""", "bulk_raw"))
def p14(t):
    return shifted(t).select("l_orderkey", "l_linenumber", "ts", aqi.index_ceiling(c("pm25")).alias("aqi"))


@query("p15_aqi_live", sql(f"""
  select l_orderkey, l_linenumber::bigint as l_linenumber, ts, {LIVE_SQL} as aqi from ({SHIFTED})""", "bulk_raw"))
def p15(t):
    return shifted(t).select("l_orderkey", "l_linenumber", "ts", aqi.index_live(c("pm25")).alias("aqi"))


@query("p16_aqi_overall", sql(f"""
  select station_id, ts, greatest({strict_sql('pm25', PM25_BANDS)}, {strict_sql('pm10', PM10_BANDS)}) as aqi
  from bulk""", "bulk"), rounds={"aqi": 6})
def p16(t):
    return t.bulk.select("station_id", "ts", aqi.overall(
        aqi.index_strict(c("pm25")), aqi.index_strict(c("pm10"), "pm10")).alias("aqi"))


@query("p17_aqi_category", sql(f"""
  select station_id, ts, {CAT_SQL.format(x='aqi')} as aqi_cat from (
    select station_id, ts, greatest({strict_sql('pm25', PM25_BANDS)}, {strict_sql('pm10', PM10_BANDS)}) as aqi
    from bulk)""", "bulk"))
def p17(t):
    index = aqi.overall(aqi.index_strict(c("pm25")), aqi.index_strict(c("pm10"), "pm10"))
    return t.bulk.select("station_id", "ts", aqi.category(index).alias("aqi_cat"))


# Bounds and texts written out, apart from the tables of advice and warnings, so that a change of those shows.
ADVICE_SQL = """
    case
      when aqi <= 50 then 'Ideal conditions across Dhaka. Open-air commutes via rickshaw or bicycle pose minimal respiratory strain.'
      when aqi <= 100 then 'Acceptable air. Unusually sensitive individuals on major arterial routes (Airport Rd, Mirpur Rd) should take light precautions.'
      when aqi <= 150 then 'Active commuters on open CNGs, rickshaws, and motorcycles will experience particulate irritation during rush hour.'
      when aqi <= 200 then 'Heavy exhaust and brick-kiln smoke trapping. Motorcyclists and open-vehicle commuters face elevated fine particulate deposition.'
      when aqi is not null then 'CRITICAL: Severe thermal inversion in progress. High concentrations of combustion soot and toxic aerosol.' end as commuter,
    case
      when aqi <= 50 then 'Masking not required for general population.'
      when aqi <= 100 then 'Surgical or cloth mask optional for dust protection.'
      when aqi <= 150 then 'N95 / KN95 particulate respirator strongly recommended for children, asthmatics, and transit police.'
      when aqi <= 200 then 'Mandatory N95 / FFP2 respirators with airtight seal for anyone outdoors >30 minutes.'
      when aqi is not null then 'Strict N95/P100 respirator requirement. Eliminate outdoor walking and cycling.' end as mask,
    case
      when aqi <= 50 then 'Open windows across Mirpur, Dhanmondi, and Gulshan for natural convective exchange.'
      when aqi <= 100 then 'Windows can remain open; best air exchange window between 12:00 PM and 3:30 PM.'
      when aqi <= 150 then 'Keep windows closed during early morning rush hours (08:00–10:00). Open briefly around solar noon.'
      when aqi <= 200 then 'Seal residential windows; run HEPA air purification where available. Avoid natural ventilation before 1:00 PM.'
      when aqi is not null then 'Complete window sealing. Do not open windows. Vulnerable groups must remain indoors.' end as ventilation,
    case when pm25 is null or pm25 < 0 then 'No data available.'
      when pm25 > 500.4 then '🟤 Extreme Health Alert: Hazardous toxic conditions. Remain indoors completely.'
      when pm25 between 0.0 and 12.0 then '🟢 Minimal health impact. Air quality is considered satisfactory.'
      when pm25 between 12.1 and 35.4 then '🟡 Acceptable quality. Very sensitive individuals may experience minor respiratory symptoms.'
      when pm25 between 35.5 and 55.4 then '🟠 General public not likely affected; active children/adults and people with respiratory disease should limit outdoor exertion.'
      when pm25 between 55.5 and 150.4 then '🔴 Everyone may begin to experience health effects; sensitive groups may experience more serious effects. Avoid prolonged outdoor exertion.'
      when pm25 between 150.5 and 250.4 then '🟣 Health warnings of emergency conditions. The entire population is more likely to be affected. Stay indoors.'
      when pm25 between 250.5 and 500.4 then '🟤 Health alert: everyone may experience more serious health effects. Remain indoors and keep activity levels low.'
      else 'Unknown' end as warning"""


@query("p18_advice", sql(f"""
  select l_orderkey, l_linenumber::bigint as l_linenumber, ts, {ADVICE_SQL}
  from (select *, {CEIL_SQL} as aqi from ({SHIFTED}))""", "bulk_raw"))
def p18(t):
    commuter, mask, ventilation = aqi.advice(aqi.index_ceiling(c("pm25")))
    return shifted(t).select(
        "l_orderkey", "l_linenumber", "ts", commuter.alias("commuter"), mask.alias("mask"),
        ventilation.alias("ventilation"), aqi.warning(c("pm25")).alias("warning"))


BLH_SQL = """round(least(greatest(base + least(greatest(sin((hour(ts) - 6) * pi() / 12), -0.75), 1.0) * base * 0.70
    + greatest((temperature - 20.0) * 12.0, 0) + greatest(wind_speed * 15.0, 0), 120.0), 2700.0), 1)"""
BLH_FROM = """(select *, case when month(ts) in (12, 1, 2) then 360.0 when month(ts) in (3, 4, 5) then 920.0
    when month(ts) in (6, 7, 8, 9) then 1680.0 else 680.0 end::double as base
  from (select l_orderkey, l_linenumber, l_shipdate + to_hours((l_orderkey % 24)::int) as ts, l_quantity as temperature,
    l_discount * 300 as wind_speed from lineitem))"""


def sky(t):
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", F.expr("l_shipdate + make_dt_interval(0, cast(l_orderkey % 24 as int))").alias("ts"),
        c("l_quantity").alias("temperature"), (c("l_discount") * 300).alias("wind_speed")).withColumn(
        "blh_m", atmosphere.boundary_layer_height(F.hour("ts"), F.month("ts"), c("temperature"), c("wind_speed")))


@query("p19_boundary_layer", f"""
  select l_orderkey, l_linenumber::bigint as l_linenumber, ts, {BLH_SQL} as blh_m from {BLH_FROM}""")
def p19(t):
    return sky(t).select("l_orderkey", "l_linenumber", "ts", "blh_m")


@query("p20_boundary_status", f"""
  select l_orderkey, l_linenumber::bigint as l_linenumber, ts,
    case when {BLH_SQL} < 400 then '⚠️ Severe Nocturnal Trapping' when {BLH_SQL} < 900 then 'Moderate Dispersion'
         else 'Active Convective Flushing' end as status from {BLH_FROM}""")
def p20(t):
    return sky(t).select("l_orderkey", "l_linenumber", "ts", atmosphere.height_status(c("blh_m")).alias("status"))


@query("p21_station_names", """
  select s_suppkey, case when s_suppkey % 2 = 0 then s_name || ', Road ' || s_suppkey::varchar else s_name end as clean_name,
    s_name as short_name from supplier""")
def p21(t):
    k = c("s_suppkey")
    raw = F.concat(
        F.lit("\" '"), "s_name", F.when(k % 2 == 0, F.concat(F.lit(", Road "), k.cast("string"))).otherwise(""),
        F.when(k % 3 == 0, text.NAME_SUFFIXES[0]).when(k % 3 == 1, text.NAME_SUFFIXES[1]).otherwise(""), F.lit("' "))
    named = t.raw("supplier").select("s_suppkey", text.clean_name(raw).alias("clean_name"))
    return named.withColumn("short_name", text.short_name(c("clean_name")))


@query("p22_risk_tier", sql("""
  select station_id, season, case when health_impact_score >= 0.50 then '🔴 Critical Risk (Hotspot)'
      when health_impact_score >= 0.28 then '🟠 Moderate Risk (Elevated)' else '🟢 Lower Relative Risk (Buffer)' end as tier,
    case when health_impact_score >= 0.50 then 18 when health_impact_score >= 0.28 then 14 else 12 end::bigint as pin_size
  from ranking""", "ranking"))
def p22(t):
    label, size = health.risk_tier(c("health_impact_score"))
    return H.impact_ranking(t.peopled).select("station_id", "season", label.alias("tier"), size.alias("pin_size"))


@query("p23_wind_sector", sql("""
  select station_id, ts_hour, ((floor(((wind_direction % 360) + 22.5) / 45) * 45) % 360)::bigint as sector
  from weather""", "weather"))
def p23(t):
    return t.weather.select("station_id", "ts_hour", atmosphere.wind_sector(c("wind_direction")).alias("sector"))


@query("p24_day_type", sql("""
  select station_id, ts, case when dayofweek(ts) in (0, 6) then 'Weekend' else 'Weekday' end as day_type,
    case when dayofweek(ts) in (5, 6) then 'Weekend' else 'Weekday' end as local_day_type from bulk""", "bulk"))
def p24(t):
    dow = F.dayofweek("ts")
    return t.bulk.select("station_id", "ts", day_type(dow).alias("day_type"), day_type(dow, (6, 7)).alias("local_day_type"))


@query("p25_rename_map", sql("""
  select station_id, ts_hour as time, temperature as temperature_2m, humidity as relative_humidity_2m,
    wind_speed as wind_speed_10m, wind_direction as wind_direction_10m, pressure as surface_pressure from weather""",
    "weather"))
def p25(t):
    back = {new: old for old, new in WEATHER_RENAME.items()}
    return t.weather.withColumnsRenamed({**back, "ts_hour": "time"})


for _n, _s in (("p26_traffic_score", SOURCES[0]), ("p27_kiln_score", SOURCES[1]),
               ("p28_biomass_score", SOURCES[2]), ("p29_construction_score", SOURCES[3])):
    query(_n, sql(f"select station_id, ts, {_s} from scored", "scored"), rounds={_s: 6})(
        lambda t, s=_s: t.scored.select("station_id", "ts", s))


@query("p30_likely_source", sql("""
  select station_id, ts, case when best <= 0 or (tr = best)::int + (bk = best)::int + (bi = best)::int + (co_ = best)::int > 1
      then 'mixed' when tr = best then 'traffic' when bk = best then 'brick_kiln' when bi = best then 'biomass'
      else 'construction' end as source_signature
  from (select *, greatest(tr, bk, bi, co_) as best from (select station_id, ts, round(score_traffic, 9) as tr,
    round(score_brick_kiln, 9) as bk, round(score_biomass, 9) as bi, round(score_construction, 9) as co_ from scored))""",
    "scored"))
def p30(t):
    return t.scored.select("station_id", "ts", signatures.likely_source().alias("source_signature"))


@query("p31_relative_share", sql("""
  select station_id, ts, score_traffic / tot * 100 as score_traffic, score_brick_kiln / tot * 100 as score_brick_kiln,
    score_biomass / tot * 100 as score_biomass, score_construction / tot * 100 as score_construction
  from (select *, case when s = 0 then 1 else s end as tot from (select *, score_traffic + score_brick_kiln
    + score_biomass + score_construction as s from scored))""", "scored"), rounds={s: 6 for s in SOURCES})
def p31(t):
    return t.scored.select("station_id", "ts", *[e.alias(n) for n, e in signatures.relative_shares().items()])


@query("p32_dominant_source", sql("""
  select 'ST' || s_suppkey::varchar as station_id, coalesce(case
    when k > 0.15 then 'Brick Kilns (' || round_even(k * 100, 0)::bigint::varchar || '%) & Construction'
    when d > 0.50 then 'Construction Dust (' || round_even(d * 100, 0)::bigint::varchar || '%)'
    when tr is not null then 'Traffic Exhaust (' || round_even(tr * 100, 0)::bigint::varchar || '%)' end,
    'Construction & Vehicular Traffic') as dominant_source
  from supplier left join (select station_id, avg(score_traffic) as tr, avg(score_brick_kiln) as k,
    avg(score_construction) as d from station_season_scores group by 1) p
  on p.station_id = 'ST' || s_suppkey::varchar""", "station_season_scores"))
def p32(t):
    everyone = t.raw("supplier").select(station_of("s_suppkey").alias("station_id"))
    return dominant_sources(everyone, by_station_season(t.scored))


@query("p33_attributable_risk", sql("""
  select station_id, ts, case when pm25 is not null then (1 - exp(-0.008 * greatest(pm25 - 5, 0))) * 100 end as ar_pope,
    case when pm25 is not null then (1 - exp(-0.0086 * greatest(pm25 - 5, 0))) * 100 end as ar_india,
    case when pm10 is not null then (1 - exp(-0.004 * greatest(pm10 - 45, 0))) * 100 end as ar_daily from bulk""",
    "bulk"), rounds={"ar_pope": 6, "ar_india": 6, "ar_daily": 6})
def p33(t):
    return t.bulk.select(
        "station_id", "ts", health.attributable_risk_pct(c("pm25"), 0.008, 5.0).alias("ar_pope"),
        health.attributable_risk_pct(c("pm25"), 0.0086, 5.0).alias("ar_india"),
        health.attributable_risk_pct(c("pm10"), 0.004, 45.0).alias("ar_daily"))


@query("p34_attributable_deaths", sql("""
  select b.station_id, ts, coalesce(p.population_catchment, 10356500 / 6.0::double) * 0.0061 * ar / 100 as deaths
  from (select station_id, ts, (1 - exp(-0.008 * greatest(pm25 - 5, 0))) * 100 as ar from bulk where pm25 is not null) b
  left join population p using (station_id)""", "bulk", "population"),
    rounds={"deaths": 4})
def p34(t):
    some = t.population.select("station_id", "population_catchment")
    joined = t.bulk.where(c("pm25").isNotNull()).join(some, "station_id", "left")
    risk = health.attributable_risk_pct(c("pm25"), 0.008, 5.0)
    return joined.select("station_id", "ts", health.attributable_deaths(c("population_catchment"), risk).alias("deaths"))


@query("p35_daily_excess_deaths", sql("""
  select station_id, ts, population_catchment * 6.1 / 1000 / 365
    * (case when pm10 is not null then (1 - exp(-0.004 * greatest(pm10 - 45, 0))) * 100 end) / 100 as excess_deaths
  from peopled""", "peopled"), rounds={"excess_deaths": 6})
def p35(t):
    risk = health.attributable_risk_pct(c("pm10"), 0.004, 45.0)
    return t.peopled.select(
        "station_id", "ts", health.excess_deaths_per_day(c("population_catchment"), risk).alias("excess_deaths"))


@query("p36_impact_score", sql("""
  select station_id, ts, round(pm25 * population_catchment * 0.0086 / 1e6, 4) as score
  from peopled""", "peopled"))
def p36(t):
    return t.peopled.select("station_id", "ts", health.impact_score(
        c("pm25"), c("population_catchment")).alias("score"))


@query("p37_exposure_risk_score", sql("""
  select station_id, ts, pm25 * population_catchment
    * (1 - exp(-0.0086 * greatest(pm25 - 5, 0))) * 100 as score from peopled""", "peopled"), rounds={"score": 1})
def p37(t):
    risk = health.attributable_risk_pct(c("pm25"), 0.0086, 5.0)
    return t.peopled.select("station_id", "ts", (
        health.exposure(c("pm25"), c("population_catchment")) * risk).alias("score"))


@query("p38_default_fills", sql("""
  select r.station_id, r.event_id, coalesce(p.population_catchment, 650309)::bigint as population,
    coalesce(p.population_catchment, 600000)::bigint as population_coarse,
    coalesce(value, coalesce(p.population_catchment, 650309) * 0.0018) as deaths
  from readings r left join population p using (station_id)""",
    "readings", "population"), rounds={"deaths": 6})
def p38(t):
    fine = joins.with_population(t.readings, t.population).withColumnRenamed("population_catchment", "population")
    both = joins.with_population(fine, t.population, default=DEFAULT_CATCHMENT_COARSE).withColumnRenamed("population_catchment", "population_coarse")
    return both.select("station_id", "event_id", "population", "population_coarse",
                       F.coalesce("value", c("population") * 0.0018).alias("deaths"))


@query("p39_drop_incomplete", sql("""
  select station_id, ts, pm25, pm10, no2 from bulk where pm25 is not null and pm10 is not null and no2 is not null""",
    "bulk"), rounds={"pm25": 6, "pm10": 6, "no2": 6})
def p39(t):
    return t.bulk.select("station_id", "ts", "pm25", "pm10", "no2").na.drop(subset=["pm25", "pm10", "no2"])


@query("p40_metric_selector", sql("""
  select station_id, season, 'ar_pct' as metric, ar_pct as metric_val from ranking union all
  select station_id, season, 'mean_pm25', mean_pm25 from ranking union all
  select station_id, season, 'health_impact_score', health_impact_score from ranking union all
  select station_id, season, 'attrib_deaths', catchment_pop * 0.0018 from ranking union all
  select station_id, season, 'catchment_pop', catchment_pop::double from ranking""", "ranking"),
    rounds={"metric_val": 6})
def p40(t):
    view = H.impact_ranking(t.peopled).withColumn("attrib_deaths", c("catchment_pop") * 0.0018)
    parts = [H.select_metric(view, m).select("station_id", "season", F.lit(m).alias("metric"), "metric_val")
             for m in H.METRICS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("p41_scatter", sql(f"""
  select round(pm25, 6) as pm25, blh_m, season from (
    select w.pm25, temperature, {BLH_SQL} as blh_m, {SEASON_SQL} as season from (
      select *, 360.0::double as base from enriched) w) where pm25 is not null and temperature is not null""", "enriched"),
    rounds={"pm25": 6})
def p41(t):
    blh = atmosphere.boundary_layer_height(F.hour("ts"), F.month("ts"), c("temperature"), c("wind_speed"))
    return t.enriched.select("pm25", blh.alias("blh_m"), season(F.month("ts")).alias("season")).na.drop()


