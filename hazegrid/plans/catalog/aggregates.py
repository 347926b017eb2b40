"""Aggregations, top rows and set operations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from hazegrid.operators import cleaning, forecast, health as H, joins, profile, signatures, sketches
from hazegrid.operators.lookup import dedupe
from hazegrid.operators.quantiles import exact_quantiles
from hazegrid.plans.catalog.expressions import CAT_SQL, PM10_BANDS, PM25_BANDS, SEASON_SQL, strict_sql
from hazegrid.plans.catalog.registry import query
from hazegrid.plans.tables import sql
from hazegrid.schema import DAILY_LIMITS, POLLUTANTS, SEASONS, SOURCES, WEATHER
from hazegrid.session import cut_lineage

c = F.col
SIX = {p: 6 for p in POLLUTANTS}
SRC = {s: 6 for s in SOURCES}
STATION_COLS = "station_id, station_name, latitude, longitude"


@query("a01_pivot_wide", sql("select * from wide", "wide"), rounds=SIX)
def a01(t):
    return t.wide


def located(t):
    return joins.with_station(t.peopled, t.stations)


@query("a02_exposure_station", sql(f"""
  select {STATION_COLS}, avg(pm25) as mean_pm25, avg(pm25 * population_catchment) as mean_exposure_score,
    max(population_catchment) as population_catchment, count(*) as n_readings
  from peopled left join stations using (station_id) where pm25 is not null group by all""", "peopled", "stations"),
    rounds={"mean_pm25": 6, "mean_exposure_score": 1})
def a02(t):
    return H.exposure_table(located(t), H.STATION_KEYS).orderBy(F.desc("mean_exposure_score"))


@query("a03_exposure_station_month", sql("""
  select station_id, month(ts) as month, avg(pm25) as mean_pm25, avg(pm25 * population_catchment) as mean_exposure_score,
    max(population_catchment) as population_catchment, count(*) as n_readings
  from peopled where pm25 is not null group by all""", "peopled"), rounds={"mean_pm25": 6, "mean_exposure_score": 1})
def a03(t):
    return H.exposure_table(t.peopled.withColumn("month", F.month("ts")), ["station_id", "month"])


@query("a04_station_means", sql("select * from means", "means"), rounds={"mean_pm25": 6, "mean_pm10": 6})
def a04(t):
    return H.station_means(t.peopled)


@query("a05_burden_table", sql("select * from burden", "burden"))
def a05(t):
    return H.burden_table(H.station_means(t.peopled))


PERIOD_SQL = """select station_id, sum(catchment_pop * 6.1 / 1000 / 365 * (1 - exp(-{beta} * greatest(m - 45, 0))))
    as period_excess_deaths_pm10, count(*) as n_days
  from (select station_id, ts::date as d, avg(pm10) as m, max(population_catchment) as catchment_pop from peopled
    where pm10 is not null group by 1, 2) group by 1"""


@query("a06_period_excess_deaths", sql(PERIOD_SQL.format(beta="0.004"), "peopled"),
       rounds={"period_excess_deaths_pm10": 4})
def a06(t):
    return H.period_excess(t.peopled)


@query("a06_period_excess_per_ten", sql(PERIOD_SQL.format(beta="0.0004"), "peopled"),
       rounds={"period_excess_deaths_pm10": 4})
def a06b(t):
    return H.period_excess(t.peopled, beta=0.0004)


@query("a07_station_season", sql("""
  select station_id, season, mean_pm25, mean_pm10, catchment_pop, n from ranking""", "ranking"),
    rounds={"mean_pm25": 6, "mean_pm10": 6})
def a07(t):
    return H.station_seasons(t.peopled)


@query("a08_scores_station_season", sql("select * from station_season_scores", "station_season_scores"), rounds=SRC)
def a08(t):
    return signatures.by_station_season(t.scored)


MEAN_SRC = ", ".join(f"avg({s}) as {s}" for s in SOURCES)


@query("a09_season_mean_of_means", sql(f"""
  select d.season, d.o as ordinal, {', '.join(SOURCES)} from (values ('Winter', 0::bigint), ('Pre-Monsoon', 1),
    ('Monsoon', 2), ('Post-Monsoon', 3)) d(season, o)
  left join (select season, {MEAN_SRC} from station_season_scores group by 1) m on m.season = d.season""",
    "station_season_scores"), rounds=SRC)
def a09(t):
    return signatures.season_profile(signatures.by_station_season(t.scored))


@query("a10_station_mean_of_means", sql(f"""
  select station_id, {MEAN_SRC} from station_season_scores group by 1""", "station_season_scores"), rounds=SRC)
def a10(t):
    return signatures.station_profile(signatures.by_station_season(t.scored))


@query("a10_station_shares", sql(f"""
  select station_id, {', '.join(f'{s} / tot * 100 as {s}' for s in SOURCES)} from (
    select *, {' + '.join(SOURCES)} as tot from (select station_id, {MEAN_SRC} from station_season_scores group by 1))""",
    "station_season_scores"), rounds=SRC)
def a10b(t):
    return signatures.station_shares(signatures.by_station_season(t.scored))


@query("a11_quartile_bounds", sql("""
  select station_id, parameter, q1, q3, q3 - q1 as iqr, q1 - 3 * (q3 - q1) as lower, q3 + 3 * (q3 - q1) as upper
  from (select station_id, parameter, quantile_disc(value, 0.25) as q1, quantile_disc(value, 0.75) as q3
    from readings where value is not null group by 1, 2)""", "readings"),
    rounds={"iqr": 6, "lower": 6, "upper": 6})
def a11(t):
    return cleaning.reading_fences(t.readings)


def clip_sql(table: str) -> str:
    q = ", ".join(f"quantile_disc({p}, 0.25) as a_{p}, quantile_disc({p}, 0.75) as b_{p}" for p in POLLUTANTS)
    out = ", ".join(
        f"case when {p} < a_{p} - 1.5 * (b_{p} - a_{p}) then a_{p} - 1.5 * (b_{p} - a_{p}) "
        f"when {p} > b_{p} + 1.5 * (b_{p} - a_{p}) then b_{p} + 1.5 * (b_{p} - a_{p}) else {p} end as {p}"
        for p in POLLUTANTS)
    return f"select station_id, ts, {out} from {table} left join (select station_id, {q} from {table} group by 1) q using (station_id)"


@query("a12_clip_outliers", sql(clip_sql("bulk"), "bulk"), rounds=SIX)
def a12(t):
    return cleaning.clip_outliers(t.bulk)


FLAG_SQL = """select event_id, station_id, parameter, ts, value,
    value is not null and (value < q1 - 3.0 * (q3 - q1) or value > q3 + 3.0 * (q3 - q1)) as is_outlier,
    case when value < q1 - 3.0 * (q3 - q1) or value > q3 + 3.0 * (q3 - q1) then null else value end as value_clean
  from readings r left join (select station_id, parameter, quantile_disc(value, 0.25) as q1,
    quantile_disc(value, 0.75) as q3 from readings where value is not null group by 1, 2) q using (station_id, parameter)"""


@query("a13_flag_outliers", sql(f"select event_id, value, is_outlier, value_clean from ({FLAG_SQL})", "readings"))
def a13(t):
    return cleaning.flag_outliers(t.readings).select("event_id", "value", "is_outlier", "value_clean")


@query("a14_outlier_summary", sql(f"""
  select parameter, count(value_clean) as valid_records, count(*) filter (where is_outlier) as outliers_flagged,
    avg(value_clean) as mean, stddev(value_clean) as std, min(value_clean) as min, max(value_clean) as max
  from ({FLAG_SQL}) group by 1""", "readings"), rounds={"mean": 6, "std": 6})
def a14(t):
    return cleaning.outlier_summary(cleaning.flag_outliers(t.readings))


@query("a15_hour_medians", sql(f"""
  select station_id, hour(ts) as hour, {', '.join(f'quantile_disc({p}, 0.5) as median_{p}' for p in POLLUTANTS)}
  from bulk group by 1, 2""", "bulk"))
def a15(t):
    return cleaning.hour_medians(t.bulk, POLLUTANTS)


@query("a16_day_medians", sql("""
  select station_id, parameter, ts::date as date, quantile_disc(value, 0.5) as daily_median from readings
  where value is not null group by 1, 2, 3""", "readings"))
def a16(t):
    return cleaning.day_medians(t.readings, "value")


@query("a17_quality_report", sql(" union all ".join(
    f"""select '{p}' as pollutant, count({p}) as valid_records, count({p}) * 100.0::double / count(*) as completeness_pct,
    coalesce(avg({p}), 0) as mean_value, coalesce(max({p}), 0) as max_value, {DAILY_LIMITS[p]}::double as daily_limit,
    coalesce(avg({p}), 0) > {DAILY_LIMITS[p]} as exceeds from wide""" for p in POLLUTANTS), "wide"),
    rounds={"completeness_pct": 6, "mean_value": 6, "max_value": 6})
def a17(t):
    return profile.quality_report(t.wide)


@query("a18_completeness", sql(" union all ".join(
    f"select station_id, '{p}' as pollutant, count({p}) * 100.0::double / count(*) as completeness_pct from wide group by 1"
    for p in POLLUTANTS), "wide"), rounds={"completeness_pct": 6})
def a18(t):
    return profile.completeness(t.wide)


@query("a19_station_coverage", sql(f"""
  select station_id, count(*) as n_rows, min(ts)::date as date_from, max(ts)::date as date_to,
    floor(epoch(max(ts) - min(ts)) / 86400)::bigint + 1 as days_span,
    {', '.join(f'round(count({p}) * 100.0::double / count(*), 1) as {p}_coverage_pct' for p in POLLUTANTS)}
  from wide group by 1""", "wide"))
def a19(t):
    return profile.coverage(t.wide)


def mean_std_sql(unit: str, table: str) -> str:
    return f"""select {unit}(ts) as {unit}, {', '.join(f'avg({p}) as {p}_mean' for p in POLLUTANTS)},
      {', '.join(f'stddev({p}) as {p}_std' for p in POLLUTANTS)} from {table} group by 1"""


MEAN_STD = {f"{p}_{k}": 6 for p in POLLUTANTS for k in ("mean", "std")}


@query("a20_monthly_profile", sql(mean_std_sql("month", "bulk"), "bulk"), rounds=MEAN_STD)
def a20(t):
    return profile.mean_std_by(t.bulk, F.month("ts"), "month")


@query("a21_diurnal_profile", sql(mean_std_sql("hour", "wide"), "wide"), rounds=MEAN_STD)
def a21(t):
    return profile.mean_std_by(t.wide, F.hour("ts"), "hour")


@query("a22_hour_by_day_type", sql("""
  select hour(ts) as hour, case when dayofweek(ts) in (0, 6) then 'Weekend' else 'Weekday' end as day_type,
    avg(pm25) as mean_pm25 from bulk where pm25 is not null group by 1, 2""", "bulk"), rounds={"mean_pm25": 6})
def a22(t):
    return profile.hour_by_day_type(t.bulk)


CORR_COLS = POLLUTANTS + WEATHER


@query("a23_correlations", sql("select * from (" + " union all ".join(
    f"select '{a}' as left_col, '{b}' as right_col, corr({a}, {b}) as r from enriched"
    for a, b in combinations(CORR_COLS, 2)) + ") where r is not null and not isnan(r)", "enriched"), rounds={"r": 6})
def a23(t):
    return profile.correlations(t.enriched, CORR_COLS)


DESC = ["pm25", "pm10", "no2", "o3", "so2", "co", "population_catchment"]


@query("a24_describe", sql(" union all ".join(
    f"""select '{p}' as "column", count({p}) as n, avg({p})::double as mean, stddev({p}) as std, min({p})::double as min,
    max({p})::double as max, round((count(*) - count({p})) * 100.0::double / count(*), 1) as null_pct,
    quantile_cont({p}, 0.25)::double as q25, quantile_cont({p}, 0.5)::double as q50, quantile_cont({p}, 0.75)::double as q75
    from peopled""" for p in DESC), "peopled"),
    rounds={"mean": 4, "std": 4, "q25": 6, "q50": 6, "q75": 6})
def a24(t):
    return profile.describe(t.peopled, DESC)


@query("a25_seasonal_box", sql(f"""
  with s as (select {SEASON_SQL} as season, pm25 from bulk where pm25 is not null),
  q as (select season, quantile_cont(pm25, 0.25) as q1, quantile_cont(pm25, 0.5) as median,
    quantile_cont(pm25, 0.75) as q3 from s group by 1)
  select season, any_value(q1) as q1, any_value(median) as median, any_value(q3) as q3,
    min(pm25) filter (where pm25 between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as whisker_low,
    max(pm25) filter (where pm25 between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as whisker_high,
    count(*) filter (where pm25 not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as n_outliers
  from s join q using (season) group by 1""", "bulk"),
    rounds={"q1": 6, "median": 6, "q3": 6, "whisker_low": 6, "whisker_high": 6})
def a25(t):
    return profile.seasonal_box(t.bulk)


@query("a26_exceedance_calendar", sql("""
  select year(d) as year, dayofyear(d) as day_of_year, pm25, pm25 > 15 as exceeds
  from (select ts::date as d, avg(pm25) as pm25 from bulk group by 1) where pm25 is not null""", "bulk"),
    rounds={"pm25": 6})
def a26(t):
    return profile.exceedance_calendar(t.bulk)


@query("a27_headline", sql("""
  select count(distinct station_id) as stations, avg(pm25) as mean_pm25, max(pm25) as max_pm25,
    count(*) filter (where pm25 > 15) * 100.0::double / count(*) as exceed_pct from bulk""", "bulk"),
    rounds={"mean_pm25": 6, "exceed_pct": 6})
def a27(t):
    return profile.headline(t.bulk)


@query("a28_station_vs_limit", sql("""
  select station_id, avg(pm25) as mean_pm25, avg(pm25) > 15 as above_limit from bulk where pm25 is not null group by 1""",
    "bulk"), rounds={"mean_pm25": 6})
def a28(t):
    return profile.station_vs_limit(t.bulk).orderBy("mean_pm25")


@query("a29_wind_profile", sql("""
  select d.s as sector, d.o as ordinal, m.mean_pm25 from (select range * 45 as s, range as o from range(8)) d left join (
    select ((floor(((wind_direction % 360) + 22.5) / 45) * 45) % 360)::bigint as sector, avg(pm25) as mean_pm25
    from enriched where pm25 is not null and wind_direction is not null group by 1) m on m.sector = d.s""", "enriched"),
    rounds={"mean_pm25": 6})
def a29(t):
    return profile.wind_profile(t.enriched)


AQI = f"greatest({strict_sql('pm25', PM25_BANDS)}, {strict_sql('pm10', PM10_BANDS)})"


@query("a30_station_aqi", sql(f"""
  select station_id, avg(aqi) as mean_aqi, count(*) as n, {CAT_SQL.format(x='avg(aqi)')} as aqi_cat
  from (select station_id, {AQI} as aqi from wide) where aqi is not null group by 1""", "wide"),
    rounds={"mean_aqi": 6})
def a30(t):
    from hazegrid.functions import aqi
    return profile.station_aqi(t.wide).withColumn("aqi_cat", aqi.category(c("mean_aqi"))).orderBy(F.desc("mean_aqi"))


@query("a31_weighted_exposure_station", sql("""
  select station_id, mean_pm25, catchment_pop as population_catchment, mean_pm25 * catchment_pop / 1e6 as pwe_score
  from means where mean_pm25 is not null""", "means"), rounds={"mean_pm25": 6, "pwe_score": 6})
def a31(t):
    return H.weighted_exposure_score(t.peopled)


@query("a32_seasonal_city_burden", sql(f"""
  select d.season, d.o as ordinal, mean_pm25, mean_pm10, n, (1 - exp(-0.0086 * greatest(mean_pm25 - 5, 0))) * 100 as ar_pm25_pct,
    (1 - exp(-0.0086 * greatest(mean_pm25 - 5, 0))) * 10356500 * 6.1 / 1000 as attrib_deaths_est
  from (values ('Winter', 0::bigint), ('Pre-Monsoon', 1), ('Monsoon', 2), ('Post-Monsoon', 3)) d(season, o) left join (
    select {SEASON_SQL} as season, avg(pm25) as mean_pm25, avg(pm10) as mean_pm10, count(*) as n from bulk
    where pm25 is not null group by 1) m on m.season = d.season""", "bulk"),
    rounds={"mean_pm25": 6, "mean_pm10": 6, "ar_pm25_pct": 6, "attrib_deaths_est": 3})
def a32(t):
    return H.seasonal_city_burden(t.bulk)


@query("a33_city_weighted_mean", sql("""
  select sum(mean_pm25 * catchment_pop) / sum(catchment_pop) as city_weighted_pm25 from means""", "means"),
    rounds={"city_weighted_pm25": 6})
def a33(t):
    return H.city_weighted_mean(H.station_means(t.peopled))


@query("a34_population_check", sql("""
  select sum(population_catchment)::bigint as catchment_sum, sum(population_catchment) / 10356500::double as ratio,
    sum(population_catchment) / 10356500::double > 1.15 as overlap from population""", "population"), rounds={"ratio": 6})
def a34(t):
    return H.population_check(t.population)


@query("a35_ranking_rollup", sql("""
  select station_id, season, avg(mean_pm25) as mean_pm25, avg(ar_pct) as ar_pct, sum(health_impact_score) as health_score
  from ranking group by grouping sets ((station_id), (season))""", "ranking"),
    rounds={"mean_pm25": 6, "ar_pct": 6, "health_score": 6})
def a35(t):
    return H.ranking_rollup(H.impact_ranking(t.peopled))


@query("a36_score_matrix", sql("""
  select *, coalesce(winter, 0) + coalesce(pre_monsoon, 0) + coalesce(monsoon, 0) + coalesce(post_monsoon, 0) as row_total
  from (select station_id, avg(health_impact_score) filter (where season = 'Winter') as winter,
    avg(health_impact_score) filter (where season = 'Pre-Monsoon') as pre_monsoon,
    avg(health_impact_score) filter (where season = 'Monsoon') as monsoon,
    avg(health_impact_score) filter (where season = 'Post-Monsoon') as post_monsoon from ranking group by 1)""", "ranking"),
    rounds={"row_total": 6})
def a36(t):
    return H.score_matrix(H.impact_ranking(t.peopled)).orderBy(F.desc("row_total"))


@query("a37_crf_summary", sql("""
  select crf, crf_label, avg(ar_pct) as mean_ar_pct, avg(attrib_deaths) as mean_deaths, sum(attrib_deaths) as total_deaths,
    sum(catchment_pop)::bigint as total_population from burden group by 1, 2""", "burden"),
    rounds={"mean_ar_pct": 6, "mean_deaths": 4, "total_deaths": 3})
def a37(t):
    return H.burden_by_crf(H.burden_table(H.station_means(t.peopled)))


@query("a38_sensitivity_range", sql("""
  select station_id, min(attrib_deaths) as deaths_low, max(attrib_deaths) as deaths_high, min(ar_pct) as ar_low,
    max(ar_pct) as ar_high from burden group by 1""", "burden"))
def a38(t):
    return H.burden_range(H.burden_table(H.station_means(t.peopled)))


@query("a39_risk_pivot", sql("""
  select station_id, max(ar_pct) filter (where crf = 'pm25_long_term') as pm25_long_term,
    max(ar_pct) filter (where crf = 'pm25_annual') as pm25_annual from burden group by 1""", "burden"))
def a39(t):
    return H.burden_side_by_side(H.burden_table(H.station_means(t.peopled)), "ar_pct")


@query("a40_distinct_stations", sql("""
  select count(distinct station_id) as stations, count(distinct parameter) as parameters from readings""", "readings"))
def a40(t):
    return t.readings.agg(F.countDistinct("station_id").alias("stations"), F.countDistinct("parameter").alias("parameters"))


@query("a40_distinct_sketches", sql("""
  select station_id, count(distinct event_id) as events, count(distinct ts::date) as days, true as within from readings group by 1""", "readings"))
def a40_sketches(t):
    """Distinct readings per station, united from stored daily sketches, next to the exact numbers."""
    stored = cut_lineage(sketches.distinct_sketches(t.readings, ["station_id", F.to_date("ts").alias("date")], "event_id"), "sketches")
    near = sketches.distinct_counts(stored, ["station_id"], "estimate")
    exact = t.readings.groupBy("station_id").agg(F.countDistinct("event_id").alias("events"), F.countDistinct(F.to_date("ts")).alias("days"))
    return joins.join_on(exact, near, ["station_id"]).select(
        "station_id", "events", "days", (F.abs(c("estimate") - c("events")) <= c("events") * 0.02).alias("within"))


@query("a11_fences_from_sketches", sql("""
  select station_id, parameter, count(value) as n, true as within from readings where value is not null group by 1, 2""", "readings"))
def a11_sketches(t):
    """Quartiles per station and parameter from stored daily sketches: ranks within one percent of the rows of the exact ones."""
    rows = t.readings.where("value is not null")
    stored = cut_lineage(sketches.quantile_sketches(rows, ["station_id", "parameter", F.to_date("ts").alias("date")], "value"), "sketches")
    fences = sketches.fences(stored, ["station_id", "parameter"])
    ranked = joins.join_on(rows, fences, ["station_id", "parameter"]).groupBy("station_id", "parameter").agg(
        F.count("value").alias("n"), *[F.count_if(c("value") < c(q)).alias(f"below_{q}") for q in ("q1", "q3")],
        *[F.count_if(c("value") <= c(q)).alias(f"upto_{q}") for q in ("q1", "q3")])
    slack = F.greatest(c("n") * 0.01, F.lit(1.0))
    near = [(c(f"below_{q}") <= c("n") * share + slack) & (c(f"upto_{q}") >= c("n") * share - slack) for q, share in (("q1", 0.25), ("q3", 0.75))]
    return ranked.select("station_id", "parameter", "n", (near[0] & near[1]).alias("within"))


SIGN_NULLS = ", ".join(f"case when count({p}) > 0 then (count(*) - count({p})) * 100.0::double / count(*) else 0 end"
                       for p in POLLUTANTS)
HAVE_P = " + ".join(f"(count({p}) > 0)::int" for p in POLLUTANTS)
HAVE_W = " + ".join(f"(count({w}) > 0)::int" for w in WEATHER)


@query("a41_sign_off", sql(f"""
  with s as (select count(distinct station_id)::double as a, ({HAVE_P})::double as b, ({HAVE_W})::double as c_,
    count(population_catchment)::double as d, greatest({SIGN_NULLS}) as e,
    floor(epoch(max(ts) - min(ts)) / 86400)::double as f, count(*)::double as g from enriched)
  select 'Multiple stations present' as check_name, a as detail, a >= 2 as passed from s union all
  select 'Multiple pollutants with data', b, b >= 3 from s union all
  select 'Weather enrichment present', c_, c_ >= 3 from s union all
  select 'Population catchment present', d, d > 0 from s union all
  select 'Null rate < 20% (worst pollutant)', e, e < 20 from s union all
  select 'Date range >= 7 days', f, f >= 7 from s union all
  select 'Sufficient data volume (>100 rows)', g, g > 100 from s""", "enriched"), rounds={"detail": 6})
def a41(t):
    return profile.sign_off(t.enriched)


@query("a42_busiest_station", sql("""
  select station_id, count(pm25) as n from bulk group by 1 order by 2 desc, 1 limit 1""", "bulk"))
def a42(t):
    return profile.busiest_station(t.bulk)


@query("a43_join_coverage", sql("""
  select count(*) as total_rows, count(temperature) as with_weather, count(temperature) * 100.0::double / count(*) as coverage_pct
  from enriched""", "enriched"), rounds={"coverage_pct": 6})
def a43(t):
    return joins.weather_coverage(t.enriched)


@query("a44_station_extent", sql("""
  select station_id, max(latitude) as latitude, max(longitude) as longitude, min(ts) as min_ts, max(ts) as max_ts
  from readings left join stations using (station_id) group by 1""", "readings", "stations"))
def a44(t):
    return profile.station_extent(joins.with_station(t.readings, t.stations))


@query("a46_regression_metrics", sql("""
  select station_id, sqrt(avg((p - pm25) * (p - pm25))) as rmse, avg(abs(p - pm25)) as mae,
    1 - sum((p - pm25) * (p - pm25)) / nullif(var_pop(pm25) * count(pm25), 0) as r2, count(*) as n
  from (select station_id, pm25, co * 20 as p from bulk where pm25 is not null and co is not null) group by 1""", "bulk"),
    rounds={"rmse": 6, "mae": 6, "r2": 6})
def a46(t):
    preds = t.bulk.select("station_id", c("pm25").alias("target"), (c("co") * 20).alias("prediction")).na.drop()
    return forecast.regression_metrics(preds, ["station_id"])


@query("a47_hourly_city_mean", sql("""
  select date_trunc('hour', ts) as ts, avg(pm25) as pm25 from wide group by 1 having avg(pm25) is not null""", "wide"),
    rounds={"pm25": 6})
def a47(t):
    return profile.hourly_city_mean(t.wide)


@query("a48_all_season_view", sql("""
  select station_id, avg(mean_pm25) as mean_pm25, max(catchment_pop) as catchment_pop, avg(delta_c) as delta_c,
    avg(ar_pct) as ar_pct, avg(health_impact_score) as health_impact_score, min(rank) as rank from ranking group by 1""",
    "ranking"), rounds={"mean_pm25": 6, "delta_c": 6, "ar_pct": 6, "health_impact_score": 6})
def a48(t):
    return H.all_season_view(H.impact_ranking(t.peopled))


@query("a49_skill_vs_persistence", sql("""
  with m as (select 'Persistence (naive)' as model, sqrt(avg((no2 - pm10) * (no2 - pm10))) as rmse from bulk
      union all select 'scaled', sqrt(avg((so2 * 2 - pm10) * (so2 * 2 - pm10))) from bulk)
  select model, rmse, (n - rmse) * 100 / n as skill_pct from m,
    (select rmse as n from m where model = 'Persistence (naive)')""", "bulk"), rounds={"rmse": 6, "skill_pct": 6})
def a49(t):
    def scored(name, pred):
        return t.bulk.select(F.lit(name).alias("model"), c("pm10").alias("target"), pred.alias("prediction")).na.drop()
    preds = scored(forecast.BASELINE, c("no2")).unionByName(scored("scaled", c("so2") * 2))
    return forecast.skill(forecast.regression_metrics(preds, ["model"]).select("model", "rmse"))


@query("a50_daily_station_mean", sql("""
  select station_id, ts::date as date, avg(pm25) as pm25 from bulk where pm25 is not null group by 1, 2""", "bulk"),
    rounds={"pm25": 6})
def a50(t):
    return profile.daily_station_mean(t.bulk)


# ---- order, top rows, samples -----------------------------------------------------------

@query("k01_ordered_result", sql("""
  select station_id, count(*) as n from readings group by 1 order by n desc, station_id""", "readings"))
def k01(t):
    return t.readings.groupBy("station_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "station_id")


for _n in (5, 10, 15):
    query(f"k02_top_{_n}", sql(f"""
      select station_id, season, health_impact_score, rank from ranking
      order by health_impact_score desc, station_id, season limit {_n}""", "ranking"))(
        lambda t, n=_n: H.impact_ranking(t.peopled).select("station_id", "season", "health_impact_score", "rank")
        .orderBy(F.desc("health_impact_score"), "station_id", "season").limit(n))


@query("k03_first_rows", sql("""
  select station_id, ts, pm25 from bulk where pm25 is not null order by ts, station_id limit 2000""", "bulk"),
    rounds={"pm25": 6})
def k03(t):
    return forecast.first_rows(
        t.bulk.where("pm25 is not null").select("station_id", "ts", "pm25"), ["ts", "station_id"], 2000)


@query("k04_seeded_sample", sql("""
  select event_id, station_id, parameter, value from readings
  where ('0x' || left(md5('42|' || station_id || '|' || event_id::varchar), 8))::bigint / 4294967296.0::double < 0.3""", "readings"),
    rounds={"value": 6})
def k04(t):
    return forecast.seeded_sample(t.readings.select("event_id", "station_id", "parameter", "value"), ["station_id", "event_id"], 0.3)


@query("k04_bottom_sample", sql("""
  select event_id, station_id, parameter, value from readings
  order by md5('42|' || station_id || '|' || event_id::varchar), event_id limit 3000""", "readings"), rounds={"value": 6})
def k04_bottom(t):
    return forecast.bottom_sample(t.readings.select("event_id", "station_id", "parameter", "value"), ["station_id", "event_id"], 3_000)


@query("k06_category_order", sql(f"""
  select season, n, row_number() over (order by case season when 'Winter' then 0 when 'Pre-Monsoon' then 1
    when 'Monsoon' then 2 else 3 end) - 1 as ordinal
  from (select {SEASON_SQL} as season, count(*) as n from bulk group by 1)""", "bulk"))
def k06(t):
    from hazegrid.functions.calendar import season
    counts = t.bulk.groupBy(season(F.month("ts")).alias("season")).agg(F.count(F.lit(1)).alias("n"))
    return joins.on_domain(counts, "season", SEASONS).orderBy("ordinal")


# ---- sets -------------------------------------------------------------------------------

@query("u01_union_frames", sql("""
  select station_id, ts, 'hourly' as origin, pm25 from wide union all select station_id, ts, 'bulk', pm25 from bulk""",
    "wide", "bulk"), rounds={"pm25": 6})
def u01(t):
    a = t.wide.select("station_id", "ts", F.lit("hourly").alias("origin"), "pm25")
    return a.unionByName(t.bulk.select("pm25", "ts", F.lit("bulk").alias("origin"), "station_id"))


@query("u02_union_times", sql("""
  select ts from wide union select ts + interval 30 minutes from wide where hour(ts) = 3 union select ts from wide_s""",
    "wide", "wide_s"))
def u02(t):
    shifted = t.wide.where(F.hour("ts") == 3).select((c("ts") + F.expr("interval 30 minutes")).alias("ts"))
    return t.wide.select("ts").union(shifted).union(t.wide_s.select("ts")).distinct()


@query("u03_common_times", sql("select ts from wide intersect select ts_hour from weather",
                               "wide", "weather"))
def u03(t):
    return t.wide.select("ts").intersect(t.weather.select(c("ts_hour").alias("ts")))


@query("u04_distinct_and_subset", sql("""
  select station_id, parameter, min(event_id) as event_id from readings group by 1, 2""", "readings"))
def u04(t):
    return dedupe(t.readings.select("station_id", "parameter", "event_id").distinct(), ["station_id", "parameter"],
                  [c("event_id")])


@query("a24_exact_quantiles", sql("""
  select station_id, quantile_cont(pm10, 0.1) as p10, quantile_cont(pm10, 0.5) as p50, quantile_cont(pm10, 0.99) as p99
  from bulk where pm10 is not null group by 1""", "bulk"), rounds={"p10": 6, "p50": 6, "p99": 6})
def a24b(t):
    return exact_quantiles(t.bulk, ["station_id"], "pm10", {"p10": 0.1, "p50": 0.5, "p99": 0.99})
