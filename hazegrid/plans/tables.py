"""Maps the given tables to stations, readings, weather and a population grid.

Each mapping exists twice, as Spark code and as the DuckDB SQL text that the checks use.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.operators import cleaning, joins
from hazegrid.schema import POLLUTANTS

TIE = ["l_orderkey", "l_linenumber"]
# Keywords that occur in the given station names: keyword, area, people per km2.
KEYWORDS = [("red", "Red", 42_000), ("ring", "Ring", 38_000), ("bolt", "Bolt", 35_000), ("gizmo", "Gizmo", 30_000)]


def station_of(key: str) -> Column:
    return F.concat(F.lit("ST"), F.col(key).cast("string"))


class Tables:
    """Lazy DataFrames over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @staticmethod
    def readings_from(events: DataFrame) -> DataFrame:
        kind = F.col("event_type")
        parameter = (
            F.when(kind == "view", "pm25").when(kind == "click", "pm10").when(kind == "purchase", "no2")
            .when(kind == "signup", "so2").otherwise("co"))
        k = F.get_json_object("props", "$.k").cast("int")
        return events.select(
            "event_id",
            F.expr("concat('ST', user_id div 15 * 13)").alias("station_id"),  # fifteen sensors to a place; some places are no station
            "ts", parameter.alias("parameter"),
            F.when(k % 20 == 0, None).when(kind == "error", F.col("value") / 10).otherwise(F.col("value")).alias("value"),
            F.when((kind == "purchase") & (F.col("event_id") % 10 == 0), "ppb")
            .when((kind == "purchase") & (F.col("event_id") % 10 == 1), "ppm").otherwise("ug/m3").alias("unit"))

    @cached_property
    def readings(self) -> DataFrame:
        return self.readings_from(self.raw("events"))

    @cached_property
    def readings_seasonal(self) -> DataFrame:
        return self.readings.withColumn(
            "ts", F.expr("ts + make_ym_interval(0, cast(event_id % 4 as int) * 3)"))

    @cached_property
    def wide(self) -> DataFrame:
        return cleaning.hourly_wide(self.readings)

    @cached_property
    def wide_s(self) -> DataFrame:
        return cleaning.hourly_wide(self.readings_seasonal)

    @cached_property
    def bulk_raw(self) -> DataFrame:
        def gap(n: int, value: str):
            return F.when(F.col("l_orderkey") % 20 == n, None).otherwise(F.expr(value)).cast("double")
        spike = F.when(F.col("l_orderkey") % 50 == 7, 6.0).otherwise(1.0)
        return self.raw("lineitem").select(
            *TIE, station_of("l_suppkey").alias("station_id"),
            F.expr("l_shipdate + make_dt_interval(0, cast(l_orderkey % 24 as int), 0, 0)").alias("ts"),
            (gap(1, "l_partkey % 160 + l_quantity / 10") * spike).alias("pm25"),
            gap(2, "l_extendedprice / 500").alias("pm10"), gap(3, "l_discount * 1000").alias("no2"),
            gap(6, "l_extendedprice / 600").alias("o3"), gap(4, "l_tax * 500").alias("so2"),
            gap(5, "l_quantity / 10").alias("co"))

    @cached_property
    def bulk(self) -> DataFrame:
        return cleaning.deduplicate(self.bulk_raw, tie_break=TIE).select("station_id", "ts", *POLLUTANTS)

    @cached_property
    def stations(self) -> DataFrame:
        s, p = self.raw("supplier"), self.raw("part").select("p_partkey", "p_name")
        k = F.col("s_suppkey")
        return s.join(p, F.col("p_partkey") == k).select(
            station_of("s_suppkey").alias("station_id"),
            F.concat("s_name", F.lit(" | "), "p_name").alias("station_name"),
            (k * 2 / 100.0 + 23.65).alias("latitude"), ((k * 7) % 20 / 100.0 + 90.30).alias("longitude"))

    @cached_property
    def pop_grid(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            k.alias("cell_id"), (k % 40 / 100.0 + 23.60).alias("lat"),
            (F.floor(k / 40) % 35 / 100.0 + 90.25).alias("lon"),
            F.when(F.col("p_size") == 1, -99999.0).otherwise(F.col("p_size") * 100.0).alias("pop"))

    @cached_property
    def weather(self) -> DataFrame:
        start = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(l_orderkey % 720 as int), 0, 0)"
        return self.raw("lineitem").groupBy(
            station_of("l_suppkey").alias("station_id"),
            F.expr(start).alias("ts_hour"),
        ).agg(
            F.round(F.avg("l_quantity"), 3).alias("temperature"), F.round(F.avg("l_tax") * 1000, 3).alias("humidity"),
            F.round(F.avg("l_discount") * 100, 3).alias("wind_speed"),
            (F.sum("l_partkey") % 360).cast("double").alias("wind_direction"),
            F.round(F.avg("l_linenumber") + 980, 3).alias("pressure"))

    @cached_property
    def population(self) -> DataFrame:
        return joins.catchment_from_name(self.stations, KEYWORDS)

    @cached_property
    def peopled(self) -> DataFrame:
        """Bulk readings with catchment population."""
        return joins.with_population(self.bulk, self.population)

    @cached_property
    def enriched(self) -> DataFrame:
        """Hourly readings of January 2024 with weather and population."""
        return joins.with_population(joins.with_weather(self.wide, self.weather), self.population)

    @cached_property
    def scored(self) -> DataFrame:
        """Bulk readings with calendar and source scores."""
        from hazegrid.functions.calendar import with_calendar
        from hazegrid.functions.signatures import with_source_scores
        return with_source_scores(with_calendar(self.bulk))


# ---- the same mappings for DuckDB ---------------------------------------------------------

_AVG = ", ".join(f"avg(value) filter (where parameter = '{p}') as {p}" for p in POLLUTANTS)
_NN = " + ".join(f"({p} is not null)::int" for p in POLLUTANTS)
_NULLS_FIRST = ", ".join(f"{c} nulls first" for c in [*TIE, *POLLUTANTS])
_KEY_CASE = " ".join(f"when contains(lower(station_name), '{w}') then floor({d} * pi() * 9)" for w, _, d in KEYWORDS)

# The scores written out, apart from the table of rules, so that a changed threshold shows.
_SCORES = """
        (case when hour(ts) not in (8, 9, 10, 17, 18, 19, 20) or dayofweek(ts) in (0, 6) then 0
              when no2 > 30 and pm10 > 60 then least(1, 0.45 + 0.30 * least(no2 / 80.0::double, 1) + 0.25 * least(pm10 / 120.0::double, 1))
              else 0.3 end)::double as score_traffic,
        (case when month(ts) not in (11, 12, 1, 2, 3, 4) or hour(ts) not between 6 and 12 then 0
              when so2 > 15 and pm10 > 80 then least(1, 0.35 * least(so2 / 50.0::double, 1) + 0.30 * least(pm10 / 150.0::double, 1)
                + case month(ts) when 12 then 0.20 when 1 then 0.20 when 2 then 0.20 when 11 then 0.14 when 3 then 0.14 else 0.08 end
                + case when hour(ts) between 7 and 11 then 0.15 else 0.075 end)
              else 0.2 end)::double as score_brick_kiln,
        (case when month(ts) not in (10, 11) or hour(ts) not between 17 and 22 then 0
              when co > 1.0 and pm25 > 50 then least(1, 0.40 * least(co / 5.0::double, 1) + 0.35 * least(pm25 / 120.0::double, 1)
                + case when month(ts) = 11 then 0.25 else 0.175 end)
              else 0.15 end)::double as score_biomass,
        (case when pm25 is null or pm10 is null or pm25 <= 0 or pm10 / pm25 <= 2.5 then 0
              when hour(ts) between 7 and 18 and pm25 > 5 then least(1, 0.50 * least((pm10 / pm25 - 2.5) / 4.5::double, 1)
                + 0.30 * least(pm10 / 200.0::double, 1) + case when hour(ts) between 9 and 16 then 0.20 else 0.10 end)
              else 0.10 end)::double as score_construction"""

CTES = {
    "readings": """select event_id, 'ST' || (user_id // 15 * 13)::varchar as station_id, ts,
        case event_type when 'view' then 'pm25' when 'click' then 'pm10' when 'purchase' then 'no2'
             when 'signup' then 'so2' else 'co' end as parameter,
        case when (props->>'$.k')::int % 20 = 0 then null
             when event_type = 'error' then value / 10 else value end as value,
        case when event_type = 'purchase' and event_id % 10 = 0 then 'ppb'
             when event_type = 'purchase' and event_id % 10 = 1 then 'ppm' else 'ug/m3' end as unit
        from events""",
    "readings_seasonal": """select event_id, station_id,
        ts + to_months((event_id % 4)::int * 3) as ts, parameter, value, unit from readings""",
    "wide": f"select station_id, date_trunc('hour', ts) as ts, {_AVG} from readings group by 1, 2",
    "wide_s": f"select station_id, date_trunc('hour', ts) as ts, {_AVG} from readings_seasonal group by 1, 2",
    "bulk_raw": """select l_orderkey, l_linenumber, 'ST' || l_suppkey::varchar as station_id,
        l_shipdate + to_hours((l_orderkey % 24)::int) as ts,
        case when l_orderkey % 20 = 1 then null else l_partkey % 160 + l_quantity / 10 end
          * case when l_orderkey % 50 = 7 then 6.0::double else 1.0::double end as pm25,
        case when l_orderkey % 20 = 2 then null else l_extendedprice / 500 end as pm10,
        case when l_orderkey % 20 = 3 then null else l_discount * 1000 end as no2,
        case when l_orderkey % 20 = 6 then null else l_extendedprice / 600 end as o3,
        case when l_orderkey % 20 = 4 then null else l_tax * 500 end as so2,
        case when l_orderkey % 20 = 5 then null else l_quantity / 10 end as co
        from lineitem""",
    "bulk": f"""select station_id, ts, {', '.join(POLLUTANTS)} from (
        select *, row_number() over (partition by station_id, ts
          order by ({_NN}) desc, {_NULLS_FIRST}) as rn from bulk_raw) where rn = 1""",
    "stations": """select 'ST' || s_suppkey::varchar as station_id,
        s_name || ' | ' || p_name as station_name,
        s_suppkey * 2 / 100.0::double + 23.65::double as latitude,
        (s_suppkey * 7) % 20 / 100.0::double + 90.30::double as longitude
        from supplier join part on p_partkey = s_suppkey""",
    "pop_grid": """select p_partkey as cell_id, p_partkey % 40 / 100.0::double + 23.60::double as lat,
        (p_partkey // 40) % 35 / 100.0::double + 90.25::double as lon,
        case when p_size = 1 then -99999.0::double else p_size * 100.0::double end as pop from part""",
    "weather": """select 'ST' || l_suppkey::varchar as station_id,
        timestamp '2024-01-01' + to_hours((l_orderkey % 720)::int) as ts_hour,
        round(avg(l_quantity), 3) as temperature, round(avg(l_tax) * 1000, 3) as humidity,
        round(avg(l_discount) * 100, 3) as wind_speed, (sum(l_partkey) % 360)::double as wind_direction,
        round(980 + avg(l_linenumber), 3) as pressure from lineitem group by 1, 2""",
    "population": f"""select station_id,
        (case {_KEY_CASE} else floor(23000 * pi() * 9) end)::bigint as population_catchment from stations""",
    "peopled": """select b.*, coalesce(p.population_catchment, 650309)::bigint as population_catchment
        from bulk b left join population p using (station_id)""",
    "enriched": """select w.*, temperature, humidity, wind_speed, wind_direction, pressure,
        coalesce(p.population_catchment, 650309)::bigint as population_catchment
        from wide w left join weather h on h.station_id = w.station_id and h.ts_hour = w.ts
        left join population p on p.station_id = w.station_id""",
    "cal": """select *, hour(ts) as hour, dayofweek(ts) + 1 as dow, month(ts) as month,
        case when month(ts) in (12, 1, 2) then 'Winter' when month(ts) in (3, 4, 5) then 'Pre-Monsoon'
             when month(ts) in (6, 7, 8, 9) then 'Monsoon' else 'Post-Monsoon' end as season from bulk""",
    "scored": f"""select *, {_SCORES} from cal""",
    "station_season_scores": """select station_id, season, avg(score_traffic) as score_traffic,
        avg(score_brick_kiln) as score_brick_kiln, avg(score_biomass) as score_biomass,
        avg(score_construction) as score_construction, count(*) as n_readings from scored group by 1, 2""",
    "means": """select station_id, avg(pm25) as mean_pm25, avg(pm10) as mean_pm10,
        max(population_catchment) as catchment_pop from peopled group by 1""",
    "crf": """select * from (values ('pm25_long_term', 0.008::double, 'PM2.5 Long-Term (Pope et al.)'),
        ('pm25_annual', 0.0086::double, 'PM2.5 Annual (India D-in-D 2024)')) t(crf, beta, crf_label)""",
    "burden": """select station_id, crf, crf_label, 'Annual' as exposure_window, 'PM25' as pollutant,
        round(mean_pm25, 2) as mean_conc, 5.0::double as who_baseline,
        round(greatest(mean_pm25 - 5.0, 0), 2) as delta_c,
        round((1 - exp(-beta * greatest(mean_pm25 - 5.0, 0))) * 100, 3) as ar_pct, catchment_pop,
        round(catchment_pop * 6.1 / 1000 * (1 - exp(-beta * greatest(mean_pm25 - 5.0, 0))), 1) as attrib_deaths
        from means, crf where mean_pm25 is not null""",
    "ranking": """select *, rank() over (order by health_impact_score desc) as rank from (
        select station_id, season, avg(pm25) as mean_pm25, avg(pm10) as mean_pm10,
          max(population_catchment) as catchment_pop, count(*) as n,
          greatest(avg(pm25) - 5.0, 0) as delta_c,
          round((1 - exp(-0.0086 * greatest(avg(pm25) - 5.0, 0))) * 100, 3) as ar_pct,
          round(avg(pm25) * max(population_catchment) * 0.0086 / 1e6, 4) as health_impact_score
        from (select p.*, case when month(ts) in (12, 1, 2) then 'Winter' when month(ts) in (3, 4, 5)
            then 'Pre-Monsoon' when month(ts) in (6, 7, 8, 9) then 'Monsoon' else 'Post-Monsoon' end as season
          from peopled p where pm25 is not null) group by 1, 2)""",
}

_NEEDS = {
    "readings_seasonal": ["readings"], "wide": ["readings"], "wide_s": ["readings_seasonal"], "bulk": ["bulk_raw"],
    "population": ["stations"], "peopled": ["bulk", "population"], "enriched": ["wide", "weather", "population"],
    "cal": ["bulk"], "scored": ["cal"], "station_season_scores": ["scored"], "means": ["peopled"],
    "burden": ["means", "crf"], "ranking": ["peopled"],
}


def sql(body: str, *ctes: str) -> str:
    """`body` with the named mappings, and what they build on, as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in ctes:
        add(name)
    if not order:
        return body
    heads = ",\n".join(f"{name} as ({CTES[name]})" for name in order)
    text = body.strip()
    if text.lower().startswith("with recursive "):
        return f"with recursive {heads},\n{text[15:]}"
    if text.lower().startswith("with "):
        return f"with {heads},\n{text[5:]}"
    return f"with {heads}\n{text}"
