"""Window operators, forecast features and the formula forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.functions.atmosphere import boundary_layer_height
from hazegrid.operators import cleaning, forecast, health as H, joins, profile
from hazegrid.plans.catalog.aggregates import FLAG_SQL
from hazegrid.plans.catalog.expressions import CEIL_SQL
from hazegrid.plans.catalog.registry import query
from hazegrid.plans.tables import TIE, sql
from hazegrid.schema import POLLUTANTS

c = F.col
SIX = {p: 6 for p in POLLUTANTS}


def carried_sql(table: str, cols: list[str] = POLLUTANTS) -> str:
    """Carry forward up to three hours, with one unlimited window per station."""
    out = ", ".join(
        f"case when {p} is not null then {p} when ts - last_value(case when {p} is not null then ts end ignore nulls) over w "
        f"<= interval 3 hours then last_value({p} ignore nulls) over w end as {p}" for p in cols)
    return (f"select station_id, ts, {out} from {table} window w as (partition by station_id order by ts "
            "rows between unbounded preceding and current row)")


def filled_sql(table: str, cols: list[str] = POLLUTANTS) -> str:
    """Carried values, then medians of the carried values per station and hour of day."""
    med = ", ".join(f"quantile_disc({p}, 0.5) as m_{p}" for p in cols)
    return (f"select l.station_id, ts, {', '.join(f'coalesce({p}, m_{p}) as {p}' for p in cols)} from ({carried_sql(table, cols)}) l "
            f"left join (select station_id, hour(ts) as h, {med} from ({carried_sql(table, cols)}) group by 1, 2) m "
            "on m.station_id = l.station_id and m.h = hour(l.ts)")


@query("w01_deduplicate", sql("select * from bulk", "bulk"), rounds=SIX)
def w01(t):
    return t.bulk


@query("w02_carry_forward_hours", sql(carried_sql("wide"), "wide"), rounds=SIX)
def w02(t):
    return cleaning.carry_forward_hours(t.wide, POLLUTANTS)


@query("w02_carry_forward_bulk", sql(carried_sql("bulk"), "bulk"), rounds=SIX)
def w02b(t):
    return cleaning.carry_forward_hours(t.bulk, POLLUTANTS)


@query("w03_carry_forward_rows", sql("""
  select event_id, case when value is not null then value when rn - last_value(case when value is not null then rn end
      ignore nulls) over w <= 3 then last_value(value ignore nulls) over w end as value
  from (select *, row_number() over (partition by station_id, parameter order by ts, event_id) as rn from readings)
  window w as (partition by station_id, parameter order by rn rows between unbounded preceding and current row)""",
    "readings"))
def w03(t):
    return cleaning.carry_forward_rows(t.readings, order=["ts", "event_id"]).select("event_id", "value")


@query("w04_fill_gaps", sql(filled_sql("wide"), "wide"), rounds=SIX)
def w04(t):
    return cleaning.fill_gaps(t.wide, POLLUTANTS)


@query("w05_fill_gaps_long", sql(f"""
  with f as ({FLAG_SQL}),
  r as (select *, row_number() over (partition by station_id, parameter order by ts, event_id) as rn from f),
  l as (select *, case when value_clean is not null then value_clean
      when rn - last_value(case when value_clean is not null then rn end ignore nulls) over w <= 3
      then last_value(value_clean ignore nulls) over w end as carried from r
    window w as (partition by station_id, parameter order by rn rows between unbounded preceding and current row))
  select event_id, is_outlier, coalesce(carried, m) as value_final from l left join (
    select station_id, parameter, ts::date as d, quantile_disc(value_clean, 0.5) as m from f
    where value_clean is not null group by 1, 2, 3) q
  on q.station_id = l.station_id and q.parameter = l.parameter and q.d = l.ts::date""", "readings"))
def w05(t):
    return cleaning.fill_gaps_long(t.readings, order=["ts", "event_id"]).select(
        "event_id", "is_outlier", c("value_clean").alias("value_final"))


def clip_of(table: str) -> str:
    q = ", ".join(f"quantile_disc({p}, 0.25) as a_{p}, quantile_disc({p}, 0.75) as b_{p}" for p in POLLUTANTS)
    return f"{table} left join (select station_id, {q} from {table} group by 1) q using (station_id)"


@query("a45_cleaning_audit", sql(f"""
  with f as ({filled_sql('bulk')}), j as (select * from {clip_of('f')})
  """ + " union all ".join(
    f"""select (select count(*) from bulk_raw) - (select count(*) from bulk) as duplicates_removed, '{p}' as "column",
    count(*) filter (where {p} is null) as nulls_left, count(*) filter (where {p} < a_{p} - 1.5 * (b_{p} - a_{p})
      or {p} > b_{p} + 1.5 * (b_{p} - a_{p})) as values_clipped from j""" for p in POLLUTANTS), "bulk"))
def a45(t):
    return cleaning.cleaning_audit(t.bulk_raw, tie_break=TIE)


@query("w04_clean_store", sql(f"""
  with f as ({filled_sql('bulk')}), j as (select * from {clip_of('f')})
  select station_id, ts, ts::date as date, year(ts) as year, month(ts) as month, {', '.join(
      f'least(greatest({p}, a_{p} - 1.5 * (b_{p} - a_{p})), b_{p} + 1.5 * (b_{p} - a_{p}))::float as {p}'
      if p != 'o3' else 'o3::float as o3' for p in POLLUTANTS)} from j""", "bulk"))
def clean_store(t):
    return cleaning.clean_store(t.bulk_raw, POLLUTANTS, tie_break=TIE).select(
        "station_id", "ts", "date", "year", "month", *POLLUTANTS)


LAG_SQL = """select station_id, ts, pm25, lag(pm25, 1) over w as pm25_lag1, lag(pm25, 24) over w as pm25_lag24,
    avg(pm25) over (partition by station_id order by ts rows between 23 preceding and current row) as pm25_roll24,
    lead(pm25, 1) over w as target from {t} where pm25 is not null window w as (partition by station_id order by ts)"""
LAGS = {"pm25": 6, "pm25_lag1": 6, "pm25_lag24": 6, "pm25_roll24": 6, "target": 6}


@query("w06_lags_and_lead", sql(f"""
  select station_id, ts, pm25_lag1, pm25_lag24, target from ({LAG_SQL.format(t='bulk')})""", "bulk"),
    rounds={k: 6 for k in ("pm25_lag1", "pm25_lag24", "target")})
def w06(t):
    return forecast.lag_features(t.bulk.where("pm25 is not null").select("station_id", "ts", "pm25")).select(
        "station_id", "ts", "pm25_lag1", "pm25_lag24", "target")


@query("w07_rolling_with_current", sql(f"""
  select station_id, ts, pm25_roll24 from ({LAG_SQL.format(t='wide')})""", "wide"), rounds={"pm25_roll24": 6})
def w07(t):
    return forecast.lag_features(t.wide.where("pm25 is not null").select("station_id", "ts", "pm25")).select(
        "station_id", "ts", "pm25_roll24")


@query("w08_rolling_past_only", sql("""
  select station_id, ts, case when count(pm25) over p >= 6 then avg(pm25) over p end as pm25_roll24 from bulk
  where pm25 is not null window p as (partition by station_id order by ts rows between 24 preceding and 1 preceding)""",
    "bulk"), rounds={"pm25_roll24": 6})
def w08(t):
    rows = t.bulk.where("pm25 is not null").select("station_id", "ts", "pm25")
    return forecast.lag_features(rows, past_only=True).select("station_id", "ts", "pm25_roll24")


@query("w06_lags_on_spine", sql("""
  with s as (select station_id, unnest(generate_series(max(ts) - interval 71 hours, max(ts), interval 1 hour)) as ts
    from wide group by 1)
  select s.station_id, s.ts, pm25, lag(pm25, 1) over w as pm25_lag1, lag(pm25, 24) over w as pm25_lag24
  from s left join wide on wide.station_id = s.station_id and wide.ts = s.ts
  window w as (partition by s.station_id order by s.ts)""", "wide"),
    rounds={k: 6 for k in ("pm25", "pm25_lag1", "pm25_lag24")})
def w06_spine(t):
    spine = joins.on_spine(t.wide.select("station_id", "ts", "pm25"), 72)
    return forecast.lag_features(spine).select("station_id", "ts", "pm25", "pm25_lag1", "pm25_lag24")


@query("w09_weekly_trend", sql("""
  select station_id, date, pm25, avg(pm25) over (partition by station_id order by date rows between 6 preceding and current row)
    as rolling_mean from (select station_id, ts::date as date, avg(pm25) as pm25 from bulk where pm25 is not null group by 1, 2)""",
    "bulk"), rounds={"pm25": 6, "rolling_mean": 6})
def w09(t):
    return profile.weekly_trend(t.bulk)


@query("w10_impact_rank", sql("select * from ranking", "ranking"),
       rounds={"mean_pm25": 6, "mean_pm10": 6, "delta_c": 6})
def w10(t):
    return H.impact_ranking(t.peopled)


@query("w11_chronological_split", sql("""
  select station_id, ts, row_number() over (partition by station_id order by ts)
    <= floor(count(*) over (partition by station_id) * 0.8::double) as is_train from bulk where pm25 is not null""", "bulk"))
def w11(t):
    return forecast.chronological_split(t.bulk.where("pm25 is not null").select("station_id", "ts"))


@query("w12_live_vector", sql("""
  with s as (select station_id, unnest(generate_series(max(ts) - interval 71 hours, max(ts), interval 1 hour)) as ts
    from wide group by 1),
  u as (select station_id, ts, max(pm25) as pm25 from (select station_id, ts, pm25 from wide union all select station_id, ts, null from s) group by 1, 2),
  f as (select station_id, ts, last_value(pm25 ignore nulls) over (partition by station_id order by ts
      rows between unbounded preceding and current row) as pm25 from u),
  b as (select f.*, row_number() over (partition by station_id order by ts desc) as back from f join s using (station_id, ts))
  select station_id, max(ts) as ts, max(pm25) filter (where back = 1) as pm25_lag1,
    max(pm25) filter (where back = 24) as pm25_lag24, avg(pm25) filter (where back <= 24) as pm25_roll24
  from b group by 1""", "wide"), rounds={"pm25_lag1": 6, "pm25_lag24": 6, "pm25_roll24": 6})
def w12(t):
    return forecast.live_vector(joins.on_spine(t.wide.select("station_id", "ts", "pm25"), 72, carry=("pm25",)))


@query("w13_rank_divergence", sql("""
  select *, raw_rank - health_rank as rank_shift from (select *, rank() over (order by health_score desc) as health_rank,
    rank() over (order by mean_pm25 desc) as raw_rank from (select station_id,
      round(sum(health_impact_score), 6) as health_score, round(avg(mean_pm25), 6) as mean_pm25 from ranking group by 1))""",
    "ranking"))
def w13(t):
    return H.rank_divergence(H.impact_ranking(t.peopled))


# ---- model input and baselines ----------------------------------------------------------

BLH = """round(least(greatest(base + least(greatest(sin((hour(ts) - 6) * pi() / 12), -0.75), 1.0) * base * 0.70
    + greatest((temperature - 20.0) * 12.0, 0) + greatest(wind_speed * 15.0, 0), 120.0), 2700.0), 1)"""
FEATURES_SQL = f"""select station_id, ts, target, pm25_lag1, pm25_lag24, pm25_roll24, hour(ts) as hour,
    dayofweek(ts) + 1 as dow, month(ts) as month, 0::bigint as season_code, temperature, humidity, wind_speed, blh_m
  from (select l.*, temperature, humidity, wind_speed, case when temperature is not null then {BLH.replace('(ts)', '(l.ts)')} end as blh_m
    from ({LAG_SQL.format(t='wide')}) l left join (select *, 360.0::double as base from weather) h
    on h.station_id = l.station_id and h.ts_hour = l.ts)
  where target is not null and pm25_lag24 is not null and temperature is not null"""


@query("m01_feature_frame", sql(FEATURES_SQL, "wide", "weather"),
       rounds={k: 6 for k in ("target", "pm25_lag1", "pm25_lag24", "pm25_roll24")})
def m01(t):
    return forecast.feature_frame(t.enriched)


@query("m06_persistence", sql(f"""
  with f as (select *, row_number() over (partition by station_id order by ts) as rn,
    count(*) over (partition by station_id) as n from ({LAG_SQL.format(t='bulk')})
    where target is not null and pm25_lag24 is not null)
  select count(*) as n, sqrt(avg((pm25_lag1 - target) * (pm25_lag1 - target))) as rmse, avg(abs(pm25_lag1 - target)) as mae,
    1 - sum((pm25_lag1 - target) * (pm25_lag1 - target)) / (var_pop(target) * count(*)) as r2
  from f where rn > floor(n * 0.8::double)""", "bulk"), rounds={"rmse": 6, "mae": 6, "r2": 6})
def m06(t):
    return forecast.regression_metrics(forecast.persistence(forecast.training_table(t.bulk, weather=False)))


STATE_SQL = """select station_id, max(ts) as ts, max_by(pm25, ts) as pm25, max_by(temperature, ts) as temperature,
    max_by(wind_speed, ts) as wind_speed from enriched where pm25 is not null and temperature is not null group by 1"""
AHEAD_SQL = f"""with recursive st as ({STATE_SQL}),
  hb as (select *, {BLH} as b from (
    select st.station_id, k as step, st.ts + to_hours(k::int) as ts, 360.0::double as base, st.pm25,
      coalesce(w.temperature, st.temperature) as temperature, coalesce(w.wind_speed, st.wind_speed) as wind_speed
    from st cross join (select unnest(range(24)) as k) left join weather w
      on w.station_id = st.station_id and w.ts_hour = date_trunc('hour', st.ts) + to_hours(k::int))),
  f(station_id, step, pm25) as (
    select station_id, 0::bigint, greatest(round(pm25 * 0.85 + 800.0 / b * 15.0, 1), 6.0) from hb where step = 0
    union all
    select f.station_id, f.step + 1, greatest(round(f.pm25 * 0.85 + 800.0 / hb.b * 15.0, 1), 6.0)
    from f join hb on hb.station_id = f.station_id and hb.step = f.step + 1)
  """


def latest_state(t):
    known = t.enriched.where("pm25 is not null and temperature is not null")
    return known.groupBy("station_id").agg(
        F.max("ts").alias("ts"), *[F.max_by(k, "ts").alias(k) for k in ("pm25", "temperature", "wind_speed")])


@query("m10_day_ahead_formula", sql(
    AHEAD_SQL + f"select f.station_id, f.step, hb.ts, hb.b as blh_m, f.pm25, {CEIL_SQL.replace('pm25', 'f.pm25')} as aqi "
    "from f join hb on hb.station_id = f.station_id and hb.step = f.step", "enriched"))
def m10(t):
    return forecast.day_ahead_formula(latest_state(t), t.weather)


@query("k05_forecast_peak", sql(
    AHEAD_SQL + "select station_id, max(pm25) as peak_pm25, arg_max(step, (pm25, -step)) as peak_step from f group by 1",
    "enriched"))
def k05(t):
    return forecast.peak(forecast.day_ahead_formula(latest_state(t), t.weather))


@query("m11_next_hour_formula", sql(f"""
  select station_id, ts, greatest(round(pm25 * 0.78 + r * 0.15 + sqrt(850.0 / greatest(b, 150.0)) * 12.0, 1), 5.0) as next_pm25,
    greatest(round(pm25 * 0.85 + 800.0 / b * 15.0, 1), 6.0) as hourly_pm25
  from (select station_id, ts, pm25, {BLH.replace('base', '360.0::double')} as b, avg(pm25) over (partition by station_id
      order by ts rows between 23 preceding and current row) as r
    from enriched where pm25 is not null and temperature is not null)""", "enriched"))
def m11(t):
    known = t.enriched.where("pm25 is not null and temperature is not null")
    lagged = forecast.lag_features(known).withColumn("blh", boundary_layer_height(
        F.hour("ts"), F.month("ts"), c("temperature"), c("wind_speed")))
    return lagged.select("station_id", "ts", forecast.next_hour_formula(c("pm25"), c("pm25_roll24"), c("blh")).alias("next_pm25"),
                         forecast.hourly_formula(c("pm25"), c("blh")).alias("hourly_pm25"))


@query("m12_cold_start", sql("""
  select event_id, value as pm25_lag1, case when value is not null then greatest(10.0, value * (1.05 + 0.05 * sin(hour(ts) * pi() / 12))) end as pm25_lag24,
    (value + greatest(10.0, value * (1.05 + 0.05 * sin(hour(ts) * pi() / 12)))) / 2 as pm25_roll24
  from readings where parameter = 'pm25'""", "readings"), rounds={"pm25_lag24": 6, "pm25_roll24": 6})
def m12(t):
    rows = t.readings.where(c("parameter") == "pm25").withColumn("hour", F.hour("ts"))
    return forecast.cold_start(rows, "value").select("event_id", "pm25_lag1", "pm25_lag24", "pm25_roll24")
