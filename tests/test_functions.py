"""Column functions on the rows where they are easiest to get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from hazegrid.functions import aqi, atmosphere, calendar, geo, health, signatures, text, units
from hazegrid.schema import KNOWN_CATCHMENTS, AREA_DENSITY, AREA_POPULATION, SOURCE_RULES
from hazegrid.operators import joins

c = F.col


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(c("x"))).collect()]


CONC = [None, -1.0, 0.0, 12.0, 12.05, 12.1, 35.4, 35.45, 55.4, 150.45, 250.45, 500.4, 500.5, 1200.0]


def test_aqi_strict_leaves_gaps(spark):
    got = column(spark, CONC, "double", aqi.index_strict)
    assert got[:3] == [None, None, 0.0]
    assert got[4] is None and got[7] is None and got[9] is None and got[10] is None
    assert [got[i] for i in (3, 5, 6, 8, 11, 12, 13)] == pytest.approx([50, 51, 100, 150, 500, 500, 500])


def test_aqi_ceiling_closes_gaps(spark):
    got = column(spark, CONC, "double", aqi.index_ceiling)
    assert got == [None, 0, 0, 50, 51, 51, 100, 101, 150, 201, 301, 500, 500, 999]


def test_aqi_live(spark):
    got = column(spark, CONC, "double", aqi.index_live)
    assert got == [None, None, 0, 50, None, 51, 100, None, 150, None, None, 500, 500, 500]


def test_overall_and_category(spark):
    df = spark.createDataFrame([(None, 60.0), (None, None), (301.0, 20.0)], "a double, b double")
    got = df.select(aqi.category(aqi.overall(c("a"), c("b")))).collect()
    assert [r[0] for r in got] == ["Moderate", "Unknown", "Hazardous"]


def test_advice_and_warning(spark):
    commuter = column(spark, [None, 50, 51, 201], "int", lambda x: aqi.advice(x)[0])
    assert commuter[0] is None and [t[:5] for t in commuter[1:]] == ["Ideal", "Accep", "CRITI"]
    assert column(spark, [None, 12.05], "double", aqi.warning) == ["No data available.", "Unknown"]


def test_units(spark):
    data = [(100.0, "PPB", "no2", 188.2), (0.1, "ppm", "so2", 261.9), (0.05, "ppm", "o3", 98.05), (2.0, "ppm", "co", 2290.0),
            (7.0, "µg/m³", "no2", 7.0), (50.0, "ppb", "pm25", 0.05), (5.0, None, "co", 5.0)]
    df = spark.createDataFrame(data, "v double, u string, p string, want double")
    for r in df.select(units.to_mass_units(c("v"), c("u"), c("p")).alias("got"), "want").collect():
        assert r.got == pytest.approx(r.want)
    bounds = [("co", 100.0, 100.0), ("co", 100.1, None), ("no2", -0.1, None), ("pm25", None, None), ("other", 9e9, 9e9)]
    df = spark.createDataFrame(bounds, "p string, v double, want double")
    assert all(r.got == r.want for r in df.select(
        units.within_physical_range(c("v"), c("p")).alias("got"), "want").collect())


def test_parameter_names(spark):
    assert column(spark, ["PM2.5", " pm10 ", "N.O2"], "string", units.parameter_name) == ["pm25", "pm10", "no2"]
    assert column(spark, ["1.5", "x", None], "string", units.to_number) == [1.5, None, None]


def test_seasons(spark):
    got = column(spark, list(range(1, 13)) + [None], "int", calendar.season)
    assert got == ["Winter"] * 2 + ["Pre-Monsoon"] * 3 + ["Monsoon"] * 4 + ["Post-Monsoon"] * 2 + ["Winter", None]
    codes = column(spark, ["Winter", "Pre-Monsoon", "Monsoon", "Post-Monsoon", None], "string", calendar.season_code)
    assert codes == [0, 1, 2, 3, None]


def test_wind_sector(spark):
    got = column(spark, [0.0, 22.4, 22.5, 337.5, 359.9, 360.0, -10.0, None], "double", atmosphere.wind_sector)
    assert got == [0, 0, 45, 0, 0, 0, 0, None]


def test_boundary_layer(spark):
    df = spark.createDataFrame([(12, 1, 30.0, 10.0), (0, 7, 20.0, 0.0), (0, 1, 5.0, 0.0), (12, 7, 45.0, 60.0),
                                (5, 5, None, 3.0)], "h int, m int, t double, w double")
    got = [r[0] for r in df.select(atmosphere.boundary_layer_height(c("h"), c("m"), c("t"), c("w"))).collect()]
    # 360 * 1.7 + 120 + 150; 1680 * (1 - .75 * .7); the lower and the upper bound; missing
    assert got == [882.0, 798.0, 171.0, 2700.0, None]


def test_attributable_risk_keeps_null(spark):
    got = column(spark, [None, 3.0, 5.0, 55.0], "double", lambda x: health.attributable_risk_pct(x, 0.008, 5.0))
    assert got[:3] == [None, 0.0, 0.0] and got[3] == pytest.approx((1 - math.exp(-0.4)) * 100)


def test_deaths_without_population(spark):
    got = column(spark, [None, 600000], "long", lambda x: health.attributable_deaths(x, F.lit(10.0)))
    assert got == pytest.approx([10356500 / 6 * 0.0061 * 0.1, 366.0])


# Published rows: response function, mean, risk, catchment, deaths.
BURDEN = [("pm25_long_term", 49.93, 30.193, 565486, 1041.5), ("pm25_annual", 49.93, 32.05, 565486, 1105.6),
          ("pm25_annual", 51.32, 32.855, 508938, 1020.0), ("pm25_long_term", 67.37, 39.285, 848230, 2032.7),
          ("pm25_annual", 67.37, 41.515, 848230, 2148.1), ("pm25_long_term", 51.54, 31.088, 1187522, 2252.0),
          ("pm25_annual", 51.54, 32.986, 1187522, 2389.5), ("pm25_long_term", 56.04, 33.525, 452389, 925.1),
          ("pm25_annual", 56.04, 35.53, 452389, 980.5), ("pm25_long_term", 49.78, 30.111, 989601, 1817.6)]
# Published rows: mean, catchment, risk, score, rank.
RANKING = [(83.6774561758905, 1074424, 49.167, 0.7732, 1), (63.684814546064096, 1187522, 39.631, 0.6504, 2),
           (83.33619378730513, 848230, 49.018, 0.6079, 3), (60.011601307395665, 989601, 37.693, 0.5107, 4)]


def test_published_burden(spark):
    beta = F.when(c("crf") == "pm25_annual", 0.0086).otherwise(0.008)
    df = spark.createDataFrame(BURDEN, "crf string, conc double, ar double, pop long, deaths double")
    risk = health.attributable_risk_pct(c("conc"), beta, 5.0)
    for r in df.select("ar", "deaths", "pop", risk.alias("a"), health.attributable_deaths(c("pop"), risk).alias("d")).collect():
        # The published mean is rounded to 0.005, which moves deaths by up to pop * rate * beta * 0.005.
        assert r.a == pytest.approx(r.ar, abs=0.004)
        assert r.d == pytest.approx(r.deaths, abs=r["pop"] * 0.0061 * 0.0086 * 0.005 + 0.05)


def test_published_ranking(spark):
    from hazegrid.operators.ordering import with_rank
    df = spark.createDataFrame(RANKING, "conc double, pop long, ar double, score double, want long")
    out = with_rank(df.withColumn("got", health.impact_score(c("conc"), c("pop"))), "got", "rank")
    for r in out.withColumn("a", health.attributable_risk_pct(c("conc"), 0.0086, 5.0)).collect():
        assert r.got == r.score and r["rank"] == r.want and r.a == pytest.approx(r.ar, abs=0.0006)


def test_construction_edges(spark):
    data = [(0.0, 50.0, 10, 0.0), (None, 50.0, 10, 0.0), (10.0, 25.0, 10, 0.0), (5.0, 20.0, 10, 0.10),
            (10.0, 30.0, 6, 0.10), (10.0, 30.0, 10, 0.5 * 0.5 / 4.5 + 0.3 * 0.15 + 0.2), (10.0, None, 10, 0.0)]
    df = spark.createDataFrame(data, "pm25 double, pm10 double, h int, want double")
    ratio = F.try_divide(c("pm10"), F.when(c("pm25") > 0, c("pm25")))
    got = signatures.score(SOURCE_RULES["score_construction"], {"hour": c("h"), "pm10": c("pm10"), "pm25": c("pm25"), "ratio": ratio})
    for r in df.select(got.alias("got"), "want").collect():
        assert r.got == pytest.approx(r.want)


def test_scores_stay_within_one(spark):
    df = spark.createDataFrame(
        [(1e6, 1e6, 1e6, 1e6, 1.0), (None, None, None, None, None), (0.0, 0.0, 0.0, 0.0, 0.0)],
        "no2 double, pm10 double, so2 double, co double, pm25 double").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"), F.lit(3).alias("dow")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    scored = signatures.with_source_scores(df)
    low_high = scored.agg(*[f(s) for s in signatures.SOURCES for f in (F.min, F.max)]).first()
    assert all(0.0 <= v <= 1.0 for v in low_high)


def test_likely_source_ties(spark):
    df = spark.createDataFrame([(0.3, 0.3, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0), (0.3, 0.2, 0.1, 0.0)],
                               "score_traffic double, score_brick_kiln double, score_biomass double, score_construction double")
    assert [r[0] for r in df.select(signatures.likely_source()).collect()] == ["mixed", "mixed", "traffic"]


def test_keyword_order(spark):
    df = spark.createDataFrame([("1", "Uttara near MIRPUR"), ("2", "nowhere"), ("2796", "Mirpur"), ("3", None)],
                               "station_id string, station_name string")
    got = {r.station_id: (r.catchment_area_name, r.population_catchment)
           for r in joins.catchment_from_name(df, AREA_DENSITY, KNOWN_CATCHMENTS).collect()}
    assert got["1"] == ("Mirpur", int(38_000 * math.pi * 9))
    assert got["2"][1] == got["3"][1] == 650_309
    assert got["2796"] == ("Dhaka University/Old Dhaka", 450_000)
    coarse = joins.catchment_from_name(df, AREA_POPULATION, default=("default", 600_000), per_km2=False)
    assert {r.station_id: r.population_catchment for r in coarse.collect()}["1"] == 1_200_000


def test_names(spark):
    raw = ["\"Road 7, Ward 2 | Dhaka l Smart Air Bangladesh\"", "Plain"]
    assert column(spark, raw, "string", text.clean_name) == ["Road 7, Ward 2", "Plain"]
    assert column(spark, ["Road 7, Ward 2", "Plain"], "string", text.short_name) == ["Road 7", "Plain"]


def test_distance(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (23.8, 90.4, 23.8, 90.4), (10.0, 179.9, 10.0, -179.9)],
                               "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.great_circle_km(c("a"), c("b"), c("c"), c("d"))).collect()]
    assert got == pytest.approx([math.pi * 6371, 0.0, 21.9, ], rel=1e-3)


def test_metric_and_tier(spark):
    assert column(spark, [None, 0.5, 0.28, 0.1], "double", lambda x: health.risk_tier(x)[1]) == [None, 18, 14, 12]


def test_index_rounds_half_to_even(spark):
    from hazegrid.functions import aqi
    df = spark.createDataFrame([(0.12,), (0.6,), (3.0,), (3.36,), (9.0,)], "x double")
    got = [tuple(r) for r in df.select(aqi.index_live(F.col("x")), aqi.index_ceiling(F.col("x"))).collect()]
    # 50 / 12 times 0.12, 0.6, 3.0, 3.36 and 9.0 is 0.5, 2.5, 12.5, 14 and 37.5
    assert got == [(0, 0), (2, 2), (12, 12), (14, 14), (38, 38)]


def test_areas_across_the_date_line_and_at_the_poles(spark):
    from hazegrid.operators import spatial
    stations = spark.createDataFrame(
        [("line", 0.0, 179.99), ("west", 0.0, -179.99), ("pole", 89.99, 0.0), ("south", -90.0, 12.0), ("far", 45.0, 0.0)],
        "station_id string, latitude double, longitude double")
    cells = spark.createDataFrame(
        [(0.0, -179.995, 10.0), (0.0, 179.995, 5.0), (89.99, 180.0, 7.0), (-89.99, -100.0, 3.0), (-89.99, 100.0, 2.0), (45.0, 0.001, 1.0), (45.0, 0.001, 1.0)],
        "lat double, lon double, pop double")
    circle = {r.station_id: (r.population_catchment, r.n_cells) for r in spatial.population_in_circle(stations, cells, 4.0).collect()}
    assert circle == {"line": (15, 2), "west": (15, 2), "pole": (7, 1), "south": (5, 2), "far": (2, 1)}
    square = {r.station_id: r.population_catchment for r in spatial.population_in_square(stations, cells, 4.0, default=-1).collect()}
    assert square == {"line": 15, "west": 15, "pole": -1, "south": -1, "far": 2}


def test_whole_tiles_add_the_same_as_cells(spark):
    from hazegrid.functions.geo import great_circle_km
    from hazegrid.operators import spatial
    stations = spark.createDataFrame([(f"s{i}", 60.0 + i / 100, 10.0 + i / 50) for i in range(12)], "station_id string, latitude double, longitude double")
    cells = spark.range(20_000).select((59.9 + F.col("id") % 200 / 500).alias("lat"), (9.8 + F.floor(F.col("id") / 200) / 100).alias("lon"), (F.col("id") % 7 + 1.0).alias("pop"))
    plain = stations.join(cells, great_circle_km(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")) <= 9.0).groupBy("station_id").agg(
        F.sum("pop").cast("long").alias("p"), F.count("*").alias("n"))
    got = {(r.station_id, r.population_catchment, r.n_cells) for r in spatial.population_in_circle(stations, cells, 9.0).collect()}
    assert got == {tuple(r) for r in plain.collect()} and min(n for _, _, n in got) > 500


def test_overlay_always_applies_and_counts(spark):
    from hazegrid.operators import joins
    base = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "ts int, v double")
    seen = spark.createDataFrame([(2, 9.0), (3, None), (4, 8.0)], "ts int, v double")
    assert sorted(tuple(r) for r in joins.overlay(base, seen, "ts", "v").select("ts", "v", "n_common").collect()) == [(1, 1.0, 1), (2, 9.0, 1), (3, 3.0, 1)]
