"""The bounded-group operators give what the plain, unbounded ones give, on skewed data."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hazegrid.operators import cleaning, forecast, ordering, spatial
from hazegrid.operators.lookup import dedupe, missing_keys
from hazegrid.operators.quantiles import exact_quantiles
from hazegrid.schema import POLLUTANTS

c = F.col


@pytest.fixture(scope="module")
def series(spark):
    """A third of all rows belong to one station; gaps, odd seconds and dates before 1970."""
    return spark.range(6000).select(
        F.when(c("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("S"), (c("id") * 31 % 7).cast("string"))).alias("station_id"),
        F.expr("cast('1969-11-20' as timestamp_ntz) + make_dt_interval(0, cast(id * 7 % 6000 / 2 as int), cast(id % 60 as int), id % 3)").alias("ts"),
        F.when(c("id") * 17 % 5 != 0, c("id") * 37 % 1000 / 10).alias("pm25"),
        F.when(c("id") * 13 % 11 > 6, (c("id") % 30).cast("double")).alias("pm10"),
        "id")


def test_positions(series, rows):
    placed = ordering.with_position(series, ["station_id"], [c("ts"), c("id")], "pos", "size")
    w = Window.partitionBy("station_id")
    want = series.select("id", F.row_number().over(w.orderBy("ts", "id")).cast("long"), F.count("*").over(w))
    assert rows(placed, "id", "pos", "size") == rows(want)


@pytest.mark.parametrize("size", [3, 10, 10_000])
def test_row_windows(series, rows, size):
    def cols(w):
        return {"a": F.lag("pm25", 3).over(w), "b": F.lead("pm25", 2).over(w),
                "n": F.count("pm25").over(w.rowsBetween(-3, 1))}
    got = ordering.over_rows(series, ["station_id"], [c("ts"), c("id")], cols, 3, 2, size)
    plain = cols(Window.partitionBy("station_id").orderBy("ts", "id"))
    want = series.select("id", *[e.alias(k) for k, e in plain.items()])
    assert rows(got, "id", "a", "b", "n") == rows(want)


def test_blocks_are_as_long_as_their_margins(series, rows):
    def cols(w):
        return {"a": F.lag("pm25", 11).over(w)}
    got = ordering.over_rows(series, ["station_id"], [c("ts"), c("id")], cols, 11, 0, 4)
    want = series.select("id", F.lag("pm25", 11).over(Window.partitionBy("station_id").orderBy("ts", "id")).alias("a"))
    assert rows(got, "id", "a") == rows(want)


@pytest.fixture(scope="module")
def crowded(spark):
    """A third of all rows lie in one station and one hour, another third at one of two instants; keys and times may be null, rows repeat."""
    return spark.range(4500).select(
        F.when(c("id") % 3 < 2, "HOT").when(c("id") % 100 == 2, None).otherwise(F.concat(F.lit("S"), (c("id") % 5).cast("string"))).alias("station_id"),
        F.when(c("id") % 3 == 0, F.expr("cast('2024-01-01 07:00:00' as timestamp_ntz) + make_dt_interval(0, 0, 0, id * 7 % 3600 + id / 1000000)"))
        .when(c("id") % 3 == 1, F.expr("cast('2024-01-01 09:00:00' as timestamp_ntz) + make_dt_interval(0, 0, 0, id % 2)"))
        .when(c("id") % 50 == 2, None)
        .otherwise(F.expr("cast('2024-01-01' as timestamp_ntz) + make_dt_interval(0, cast(id * 11 % 900 as int), cast(id % 60 as int), 0)")).alias("ts"),
        F.when(c("id") * 17 % 7 > 4, c("id") * 37 % 1000 / 10).alias("pm25"), F.when(c("id") * 13 % 97 == 0, c("id") % 30 + 0.5).alias("pm10"),
        "id")


def pieces_of(df, keys, order):
    placed = ordering.in_pieces(df, keys, order)
    return [r["n"] for r in placed.groupBy("_piece").agg(F.count("*").alias("n")).collect()]


def test_pieces_are_even_however_the_rows_lie(crowded, spark):
    """No piece has more than three times its share, whether rows crowd in one hour, at one instant, or are all alike."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for df in (crowded, crowded.select(F.lit("A").alias("station_id"), F.lit(1).alias("ts"))):
            sizes = pieces_of(df, ["station_id"], [c("ts")])
            assert len(sizes) > 8 and max(sizes) < 3 * sum(sizes) / len(sizes) and sum(sizes) == 4500
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_positions_in_crowds(crowded, rows):
    placed = ordering.with_position(crowded, ["station_id"], [c("ts"), c("id")], "pos", "size")
    w = Window.partitionBy("station_id")
    want = crowded.select("id", F.row_number().over(w.orderBy("ts", "id")).cast("long"), F.count("*").over(w))
    assert rows(placed, "id", "pos", "size") == rows(want)
    assert ordering.with_position(crowded.where("false"), ["station_id"], [c("ts")]).count() == 0


def test_plans_scan_their_input_once(spark, crowded, tmp_path):
    """The input's file occurs in no plan of the result; the job that wrote the pieces scanned it."""
    crowded.write.parquet(str(tmp_path / "input"))
    df = spark.read.parquet(str(tmp_path / "input"))
    for out in (forecast.chronological_split(df.select("station_id", "ts", "id")), forecast.lag_features(df)):
        assert str(tmp_path) not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hours", [0.5, 3, 200])
@pytest.mark.parametrize("parts", [1, 16])
def test_last_known_values(crowded, series, rows, spark, hours, parts):
    """Equal to one unlimited window per station, whatever lies in one hour; a value may come from many pieces before."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for df in (crowded, series):
            # one row for each time, so that the order is given
            unique = dedupe(df.where("ts is not null"), ["station_id", "ts"], [c("id")])
            got = rows(ordering.last_known(unique, ["station_id"], "ts", ["pm25", "pm10"], hours), "id", "pm25", "pm10")
            us = ordering.micros(c("ts"))
            w = Window.partitionBy("station_id").orderBy(us).rowsBetween(Window.unboundedPreceding, 0)

            def filled(p):
                last = F.last(F.when(c(p).isNotNull(), F.struct(us.alias("us"), c(p).alias("v"))), ignorenulls=True).over(w)
                return F.when(us - last["us"] <= int(hours * 3_600_000_000), last["v"])

            assert got == rows(unique.select("id", filled("pm25"), filled("pm10")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_last_known_without_times(spark, rows):
    df = spark.createDataFrame([("A", None, 1.0), ("A", None, None), (None, 5, None), (None, 4, 2.0)], "station_id string, t int, v double")
    df = df.withColumn("ts", F.expr("cast('2024-01-01' as timestamp_ntz) + make_dt_interval(0, t)"))
    got = ordering.last_known(df, ["station_id"], "ts", ["v"], 3)
    assert rows(got, "station_id", "t", "v") == sorted([("A", None, 1.0), ("A", None, None), (None, 5, 2.0), (None, 4, 2.0)], key=repr)
    assert ordering.last_known(df.where("false"), ["station_id"], "ts", ["v"], 3).count() == 0


def test_rank(series, rows):
    got = ordering.with_rank(series, "pm25", "r")
    want = series.where("pm25 is not null").select("id", F.rank().over(Window.orderBy(F.desc("pm25"))).cast("long"))
    assert rows(got.where("pm25 is not null"), "id", "r") == rows(want)
    assert got.where("pm25 is null and r is null").count() == series.where("pm25 is null").count()
    low = ordering.with_rank(series, "pm25", "r", ["station_id"], descending=False).where("pm25 is not null")
    w = Window.partitionBy("station_id").orderBy("pm25")
    assert rows(low, "id", "r") == rows(series.where("pm25 is not null").select("id", F.rank().over(w).cast("long")))


def test_quantiles(series, spark):
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r.station_id: r for r in exact_quantiles(series, ["station_id"], "pm25", shares).collect()}
    want = series.groupBy("station_id").agg(*[F.percentile("pm25", s).alias(n) for n, s in shares.items()]).collect()
    assert len(got) == len(want)
    for r in want:
        for n in shares:
            assert got[r.station_id][n] == pytest.approx(r[n])
    one = spark.createDataFrame([(4.0,), (None,)], "v double")
    assert exact_quantiles(one, [], "v", {"m": 0.5}).first().m == 4.0


def test_dedupe_keeps_fullest(spark):
    data = [("A", 1, 5.0, None), ("A", 1, 7.0, 2.0), ("A", 1, 6.0, 2.0), ("A", 1, 6.0, 2.0), ("B", 1, None, None)]
    df = spark.createDataFrame(data, "station_id string, ts int, pm25 double, pm10 double")
    got = cleaning.deduplicate(df, cols=["pm25", "pm10"])
    assert sorted(map(tuple, got.collect())) == [("A", 1, 6.0, 2.0), ("B", 1, None, None)]


def hourly(spark, data):
    df = spark.createDataFrame(data, "station_id string, t string, pm25 double")
    return df.select("station_id", c("t").cast("timestamp_ntz").alias("ts"), "pm25")


def test_carry_forward_limits(spark):
    df = hourly(spark, [("A", "2024-01-01 00:00:00", None), ("A", "2024-01-01 01:00:00", 5.0),
                        ("A", "2024-01-01 04:00:00", None), ("A", "2024-01-01 04:00:01", None),
                        ("B", "2024-01-01 02:00:00", None), ("B", "2024-01-01 03:00:00", 9.0),
                        ("B", "2024-01-04 00:00:00", None)])
    got = [(r.station_id, r.pm25) for r in cleaning.carry_forward_hours(df, ["pm25"]).orderBy("station_id", "ts").collect()]
    assert got == [("A", None), ("A", 5.0), ("A", 5.0), ("A", None), ("B", None), ("B", 9.0), ("B", None)]


def test_fill_uses_carried_medians(spark):
    df = hourly(spark, [("A", "2024-01-01 05:00:00", 4.0), ("A", "2024-01-02 06:00:00", None),
                        ("A", "2024-01-01 06:00:00", None)])
    got = cleaning.fill_gaps(df, ["pm25"]).orderBy("ts").collect()
    assert [r.pm25 for r in got] == [4.0, 4.0, 4.0]      # the 6 o'clock median is the carried 4.0


def test_clip(series, rows):
    df = series.select("station_id", "id", (c("pm25") * F.when(c("id") % 50 == 7, 60).otherwise(1)).alias("pm25"),
                       F.lit(None).cast("double").alias("o3"))
    once = cleaning.clip_outliers(df, ["pm25", "o3"])
    assert once.count() == df.count()
    assert once.agg(F.max("pm25")).first()[0] < df.agg(F.max("pm25")).first()[0]
    assert once.where("o3 is not null").count() == 0
    fences = cleaning.quartile_fences(df, ["pm25"])
    again = once.join(fences, "station_id").where("pm25 < lower_pm25 or pm25 > upper_pm25")
    assert again.count() == 0


def test_flags_are_never_null(series):
    long = series.select("station_id", F.lit("pm25").alias("parameter"), c("pm25").alias("value"))
    flagged = cleaning.flag_outliers(long)
    assert flagged.where("is_outlier is null").count() == 0
    assert flagged.where("value_clean is null and not is_outlier").count() == long.where("value is null").count()


def test_split(series, rows):
    got = forecast.chronological_split(series.select("station_id", "ts", "id"))
    for r in got.groupBy("station_id").agg(
            F.count_if("is_train").alias("k"), F.count("*").alias("n"),
            F.max(F.when(c("is_train"), c("ts"))).alias("a"), F.min(F.when(~c("is_train"), c("ts"))).alias("b")).collect():
        assert r.k == int(r.n * 0.8) and r.a <= r.b


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(7)
    spots = [(f"S{i}", rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(60)]
    spots += [("DATE", 10.0, 179.99), ("POLE", 89.99, 0.0), ("TWIN1", 23.7, 90.4), ("TWIN2", 23.7, 90.4)]
    points = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(300)]
    # A third of all points lie in one small place.
    points += [(1000 + i, 23.7 + rng.uniform(-.01, .01), 90.4 + rng.uniform(-.01, .01)) for i in range(150)]
    points += [(2000, 10.0, -179.99), (2001, 89.98, 180.0), (2002, 23.7, 90.401), (2003, 23.7, 90.401)]
    return (spark.createDataFrame(spots, "station_id string, latitude double, longitude double"),
            spark.createDataFrame(points, "pid int, latitude double, longitude double"))


def test_nearest(places):
    import math

    def km(a, b, x, y):
        h = math.sin(math.radians(x - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(x)) * \
            math.sin(math.radians(y - b) / 2) ** 2
        return 2 * 6371 * math.asin(min(1.0, math.sqrt(h)))
    stations, points = places
    spots, pts = stations.collect(), points.collect()
    got = {r.station_id: r for r in spatial.nearest_point(stations, points, "pid").collect()}
    assert len(got) == len(spots)
    for s in spots:
        want = min((round(km(s.latitude, s.longitude, p.latitude, p.longitude), 6), p.pid) for p in pts)
        assert got[s.station_id].distance_km == pytest.approx(want[0], abs=1e-5)
        assert got[s.station_id].pid == want[1]


def test_population_near_the_pole_and_copies(spark):
    stations = spark.createDataFrame([("P", 89.5, 0.0), ("Q", 10.0, 50.0)], "station_id string, latitude double, longitude double")
    cells = spark.createDataFrame(
        [(89.5, 2.0, 10.0), (89.5, 2.0, 5.0), (89.5, 60.0, 100.0), (10.0, 50.02, -9999.0), (10.0, 50.02, 7.0), (10.0, 50.03, 2e8)],
        "lat double, lon double, pop double")
    got = {r.station_id: (r.population_catchment, r.n_cells)
           for r in spatial.population_in_circle(stations, cells, 4.0, default=1).collect()}
    assert got == {"P": (15, 1), "Q": (7, 1)}
    far = spatial.population_in_square(stations, cells.where("pop < 0"), 3.0, default=42)
    assert {r.population_catchment for r in far.collect()} == {42}


def test_missing_keys(spark):
    a = spark.createDataFrame([("A",), ("A",), ("B",), (None,)], "station_id string")
    b = spark.createDataFrame([("B",)], "station_id string")
    assert sorted((r[0] or "") for r in missing_keys(a, b, ["station_id"]).collect()) == ["", "A"]


def test_all_null_columns_survive(spark):
    df = hourly(spark, [("A", "2024-01-01 01:00:00", 5.0)]).withColumns(
        {p: F.lit(None).cast("double") for p in POLLUTANTS[1:]})
    out = cleaning.clean_store(df, POLLUTANTS).first()
    assert out.pm25 == 5.0 and all(out[p] is None for p in POLLUTANTS[1:])


@pytest.mark.parametrize("most", [0, 700, 10_000])
def test_last_known_by_group_size(crowded, series, rows, most):
    """The same values whether a group is left whole, cut into pieces, or there are groups of both kinds."""
    for df in (crowded, series):
        unique = dedupe(df, ["station_id", "ts"], [c("id")])
        us = ordering.micros(c("ts"))
        w = Window.partitionBy("station_id").orderBy(us).rowsBetween(Window.unboundedPreceding, 0)
        last = F.last(F.when(c("pm25").isNotNull() & us.isNotNull(), F.struct(us.alias("us"), c("pm25").alias("v"))), ignorenulls=True).over(w)
        want = unique.select("id", F.coalesce("pm25", F.when(us - last["us"] <= 3 * 3_600_000_000, last["v"])))
        assert rows(ordering.last_known(unique, ["station_id"], "ts", ["pm25"], 3, most), "id", "pm25") == rows(want)


@pytest.fixture(scope="module")
def untidy(crowded):
    """Repeated keys, null stations and times, spikes, and a column that is all null."""
    nulls = {p: F.lit(None).cast("double") for p in POLLUTANTS[2:]}
    spiked = crowded.withColumns({"pm25": c("pm25") * F.when(c("id") % 50 == 7, 60).otherwise(1), **nulls})
    return spiked.withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz")).repartition(5)


@pytest.mark.parametrize("most", [0, 700])
def test_store_by_group_size(untidy, rows, most):
    for f in (lambda most: cleaning.clean_store(untidy, POLLUTANTS, ["id"], most).select("station_id", "ts", *POLLUTANTS),
              lambda most: cleaning.cleaning_audit(untidy, ["id"], most=most),
              lambda most: cleaning.fill_gaps(dedupe(untidy, ["station_id", "ts"], [c("id")]), ["pm25", "pm10"], most=most)):
        assert rows(f(most)) == rows(f(10_000))


def test_store_equals_its_steps(untidy, rows):
    """Null stations are filled within themselves, and have neither medians nor fences."""
    steps = cleaning.carry_forward_hours(cleaning.deduplicate(untidy, tie_break=["id"]), POLLUTANTS)
    filled = cleaning.fill_from_hour_medians(steps, POLLUTANTS)
    cols = ["station_id", "ts", *POLLUTANTS]
    want = cleaning.enforce_schema(cleaning.clip_outliers(filled))
    assert rows(cleaning.clean_store(untidy, POLLUTANTS, ["id"]), *cols) == rows(want, *cols)
    fences = cleaning.quartile_fences(filled, POLLUTANTS)
    joined = filled.join(fences, "station_id", "left")
    audit = {r["column"]: (r.duplicates_removed, r.nulls_left, r.values_clipped) for r in cleaning.cleaning_audit(untidy, ["id"]).collect()}
    for p in POLLUTANTS:
        r = joined.agg(F.count("*").alias("n"), F.count_if(c(p).isNull()).alias("nulls"),
                       F.count_if((c(p) < c(f"lower_{p}")) | (c(p) > c(f"upper_{p}"))).alias("clipped")).first()
        assert audit[p] == (untidy.count() - r.n, r.nulls, r.clipped)


def test_rows_of_small_stations_meet_once(spark, untidy, tmp_path):
    """One shuffle of the rows for all steps of the store, the audit and carried values, with no sketches in it."""
    untidy.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))

    def shuffles(out):
        return out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(cleaning.clean_store(df, POLLUTANTS, ["id"])) == 1
    assert shuffles(cleaning.cleaning_audit(df, ["id"])) == 1
    assert shuffles(cleaning.carry_forward_hours(df, ["pm25"])) == 1
    assert shuffles(cleaning.fill_gaps(df, ["pm25"])) == 1
    # with stations in pieces one more for those, and none for joins with the few states, medians and fences
    assert shuffles(ordering.last_known(df, ["station_id"], "ts", ["pm25"], 3, 0)) == 2
    plan = cleaning.clean_store(df, POLLUTANTS, ["id"], 0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
