"""Enrichment of readings with weather, population and station facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.functions.calendar import hour_of
from hazegrid.functions.text import first_keyword
from hazegrid.operators.lookup import dedupe, join_on
from hazegrid.schema import (
    CATCHMENT_KM, CRF_ANNUAL, DEFAULT_CATCHMENT, DEFAULT_DENSITY, UNMATCHED_AREA, WEATHER,
)


def with_weather(df: DataFrame, weather: DataFrame, ts: str = "ts") -> DataFrame:
    """Hourly weather of the reading's own station. Weather grows with time, so it is not
    hinted as a broadcast."""
    keyed = df.withColumn("ts_hour", hour_of(F.col(ts)))
    return join_on(keyed, weather, ["station_id", "ts_hour"]).drop("ts_hour")


def with_city_weather(df: DataFrame, weather: DataFrame, ts: str = "ts") -> DataFrame:
    """Hourly weather shared by all stations; one row per hour is kept first."""
    keyed = df.withColumn("ts_hour", hour_of(F.col(ts)))
    return join_on(keyed, dedupe(weather, ["ts_hour"], []), ["ts_hour"]).drop("ts_hour")


def weather_coverage(enriched: DataFrame, probe: str = WEATHER[0]) -> DataFrame:
    """Rows, rows with weather, and the percentage."""
    return enriched.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count(probe).alias("with_weather"),
    ).withColumn("coverage_pct", F.try_divide(F.col("with_weather") * 100.0, F.col("total_rows")))


def with_population(df: DataFrame, population: DataFrame, default: int = DEFAULT_CATCHMENT) -> DataFrame:
    """Catchment population of the station, or the default."""
    return join_on(df, population.select("station_id", "population_catchment"), ["station_id"]).withColumn(
        "population_catchment", F.coalesce(F.col("population_catchment"), F.lit(default).cast("long")))


def with_station(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Station name and coordinates; coordinates of the reading itself win."""
    out = join_on(df, stations.withColumnsRenamed({"latitude": "_lat", "longitude": "_lon"}), ["station_id"])
    for name, backup in (("latitude", "_lat"), ("longitude", "_lon")):
        own = F.col(name) if name in df.columns else F.lit(None).cast("double")
        out = out.withColumn(name, F.coalesce(own, F.col(backup)))
    return out.drop("_lat", "_lon")


def first_keywords(texts: DataFrame, text: str, keywords: DataFrame) -> DataFrame:
    """Distinct texts (``_text``, lower-cased) that hold a keyword, and ``_first``: (place, keyword, label, amount) of the first in table order.

    `keywords` has keyword, label, amount and place; ties of place go to the smaller keyword. Each keyword is filed under one run of three characters, the one that the fewest
    texts have (keywords of fewer characters under themselves); texts and keywords meet on equal runs, and only then the whole keyword is looked for. So
    the work grows with the texts and their real candidates, not with texts times keywords. Null keywords never match, the empty one always does.
    """
    low = texts.select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text")).distinct()
    words = keywords.where("keyword is not null").select(F.lower("keyword").alias("_word"), "place", "keyword", "label", "amount")
    size = F.least(F.length("_word"), F.lit(3))

    def runs(of: Column, width: Column) -> Column:
        return F.when(F.length(of) >= width, F.transform(
            F.sequence(F.lit(1), F.length(of) - width + 1), lambda i: F.substring(of, i, width)))

    held = F.array_distinct(F.flatten(F.filter(F.transform("_sizes", lambda k: runs(F.col("_text"), k)), lambda r: r.isNotNull())))
    sized = low.withColumn("_sizes", words.agg(F.collect_set(size)).scalar())
    filed = sized.select("_text", F.explode(held).alias("_run"))
    common = filed.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    each = words.select("*", F.explode(runs(F.col("_word"), size)).alias("_run"))
    # a run that no text has rules the keyword out
    best = join_on(each.select("_word", "_run").distinct(), common, ["_run"]).groupBy("_word").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_run")).alias("_b")).where("_b.n > 0").select("_word", F.col("_b._run").alias("_run"))
    index = join_on(words, best, ["_word"], "inner")
    met = join_on(filed, index, ["_run"], "inner").where(F.contains("_text", "_word"))
    return met.groupBy("_text").agg(F.min(F.struct("place", "keyword", "label", "amount")).alias("_first"))


def _known_places(df: DataFrame, known: list[tuple], area: Column, people: Column) -> DataFrame:
    for station, name, amount in reversed(known):
        hit = F.col("station_id") == station
        area = F.when(hit, name).otherwise(area)
        people = F.when(hit, F.lit(amount).cast("long")).otherwise(people)
    return df.select("station_id", area.alias("catchment_area_name"), people.alias("population_catchment"))


def catchment_from_table(
    stations: DataFrame, keywords: DataFrame, known: list[tuple] = [],
    default: tuple = (UNMATCHED_AREA, DEFAULT_DENSITY), per_km2: bool = True,
) -> DataFrame:
    """As `catchment_from_name`, for a keyword table (keyword, label, amount, place) of any length that is data."""
    import math

    area_km2 = math.pi * CATCHMENT_KM**2 if per_km2 else 1.0
    found = first_keywords(stations, "station_name", keywords)
    named = join_on(stations.withColumn("_text", F.lower(F.coalesce("station_name", F.lit("")))), found, ["_text"])
    amount = F.coalesce("_first.amount", F.lit(default[1]))
    return _known_places(named, known, F.coalesce("_first.label", F.lit(default[0])), F.floor(amount * F.lit(area_km2)).cast("long"))


def catchment_from_name(
    stations: DataFrame, keywords: list[tuple], known: list[tuple] = [],
    default: tuple = (UNMATCHED_AREA, DEFAULT_DENSITY), per_km2: bool = True,
) -> DataFrame:
    """Area and population of a station: a known id wins, then the first keyword in table
    order found in its name, then the default. Amounts are densities unless `per_km2` is
    false. `keywords` is a fixed list here; a table of them goes to `catchment_from_table`."""
    import math

    area_km2 = math.pi * CATCHMENT_KM**2 if per_km2 else 1.0
    matched = first_keyword(F.coalesce(F.col("station_name"), F.lit("")), keywords, default)
    area, people = matched["label"], F.floor(matched["amount"] * F.lit(area_km2)).cast("long")
    return _known_places(stations, known, area, people)


def per_crf(df: DataFrame, crfs: list[tuple] = CRF_ANNUAL) -> DataFrame:
    """Repeat every row for each concentration-response function of a fixed list."""
    options = F.array(*[
        F.struct(F.lit(key).alias("crf"), F.lit(pollutant).alias("pollutant"), F.lit(beta).alias("beta"),
                 F.lit(label).alias("crf_label"))
        for key, pollutant, beta, label in crfs])
    return df.withColumn("_crf", F.explode(options)).select("*", "_crf.*").drop("_crf")


def hourly_spine(df: DataFrame, hours: int = 72, ts: str = "ts") -> DataFrame:
    """The last `hours` full hours of every station, one row each, up to its last reading."""
    last = df.groupBy("station_id").agg(F.max(hour_of(F.col(ts))).alias("_last"))
    return last.select("station_id", F.explode(F.sequence(
        F.col("_last") - F.expr(f"interval {hours - 1} hours"), F.col("_last"), F.expr("interval 1 hour"),
    )).alias("ts"))


def on_spine(df: DataFrame, hours: int = 72, carry: tuple[str, ...] = ()) -> DataFrame:
    """Hourly rows laid over the full spine; missing hours appear with null values.

    The earliest hour of any spine bounds the scan, so older rows are not shuffled. For the columns `carry`, a station's first
    hour takes the last value from before its spine where it has none of its own; those are found by a maximum per task.
    """
    spine = hourly_spine(df, hours)
    recent = df.where(F.col("ts") >= spine.agg(F.min("ts")).scalar())
    out = join_on(spine, recent, ["station_id", "ts"])
    if not carry:
        return out
    starts = spine.groupBy("station_id").agg(F.min("ts").alias("_start"))
    older = join_on(df, starts, ["station_id"]).where(F.col("ts") < F.col("_start")).groupBy("station_id").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("ts"))).alias(f"_old_{n}") for n in carry])
    laid = join_on(join_on(out, starts, ["station_id"]), older, ["station_id"])
    return laid.withColumns({
        n: F.when(F.col("ts") == F.col("_start"), F.coalesce(n, f"_old_{n}")).otherwise(F.col(n)) for n in carry}).select(*out.columns)


def overlay(base: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """Replace base values by observed ones where both exist; `n_common` tells how many keys that are, so that the
    caller can judge whether the overlay is worth using."""
    obs = observed.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_obs"))
    joined = join_on(base, obs, [key])
    common = joined.agg(F.count("_obs").alias("n_common"))
    return join_on(joined, common, []).withColumn(value, F.coalesce("_obs", value)).drop("_obs")


def on_domain(df: DataFrame, key: str, domain: list, ordinal: str = "ordinal") -> DataFrame:
    """Rows of an aggregate in the order of a fixed category list; absent categories appear
    with nulls."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    table = spark.range(1).select(F.posexplode(F.array(*[F.lit(v).cast(kind) for v in domain])).alias(ordinal, key))
    return join_on(table, df, [key]).select(key, ordinal, *[c for c in df.columns if c != key])


def fallback_join(df: DataFrame, other: DataFrame, key: str, value: str, otherwise: Column) -> DataFrame:
    """Left join of one value with a computed fallback."""
    return join_on(df, other.select(key, value), [key]).withColumn(value, F.coalesce(F.col(value), otherwise))
