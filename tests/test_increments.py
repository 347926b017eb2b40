"""Samples, keyword tables, stored sketches, replaced days and rejected records."""

import os
import random

import pytest
from pyspark.sql import functions as F

from hazegrid.operators import forecast, joins, sketches
from hazegrid.sources import landed, tables

c = F.col


# ---- samples


def test_bottom_sample(spark, rows):
    df = spark.range(5000).select((c("id") % 100).alias("k"), c("id").alias("v")).unionAll(spark.sql("select null, -1L"))
    first = rows(forecast.bottom_sample(df.repartition(1), ["k"], 300))
    assert len(first) == 300 and len(set(first)) == 300
    for parts in (3, 16):
        assert rows(forecast.bottom_sample(df.repartition(parts), ["k"], 300)) == first
    assert rows(forecast.bottom_sample(df, ["k"], 300, seed=7)) != first
    assert forecast.bottom_sample(df, ["k"], 10_000).count() == 5001
    assert forecast.bottom_sample(df.where("false"), ["k"], 10).count() == 0


# ---- keyword tables


@pytest.mark.parametrize("seed", range(3))
def test_keywords_equal_a_search_of_all(spark, rows, seed):
    draw = random.Random(seed)

    def text(n):
        return "".join(draw.choice("abAé ") for _ in range(n))

    texts = [(text(draw.randrange(14)),) for _ in range(120)] + [(None,), ("",), ("ab",), ("ab",)]
    words = [(text(draw.randrange(1, 6)), f"L{i}", i, draw.randrange(8)) for i in range(40)] + [(None, "null", 0, 0), ("b", "one", 5, 7)]
    if seed == 2:
        words.append(("", "any", 9, 99))
    keywords = spark.createDataFrame(words, "keyword string, label string, amount long, place long")
    found = joins.first_keywords(spark.createDataFrame(texts, "t string"), "t", keywords)
    want = set()
    for (t,) in texts:
        hits = [(p, w, l, a) for w, l, a, p in words if w is not None and w.lower() in (t or "").lower()]
        if hits:
            want.add(((t or "").lower(), *min(hits)))
    assert rows(found.select("_text", "_first.*")) == sorted(want, key=repr)


def test_a_hundred_thousand_keywords_need_no_nested_loop(spark):
    keywords = spark.range(100_000).select(
        F.concat(F.lit("w"), F.conv(c("id") * 7919, 10, 36)).alias("keyword"), F.lit("x").alias("label"), c("id").alias("amount"), c("id").alias("place"))
    names = spark.range(2000).select(F.concat(F.lit("station w"), F.conv(c("id") * 7919 * 40, 10, 36), F.lit(" east")).alias("n"))
    found = joins.first_keywords(names, "n", keywords)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 2000


# ---- sketches


@pytest.fixture(scope="module")
def daily(spark):
    return spark.range(60_000).select(
        F.concat(F.lit("S"), (c("id") % 3 % 2).cast("string")).alias("station_id"), (c("id") * 31 % 20).alias("day"),
        (c("id") * 7919 % 25_013).alias("v"), F.when(c("id") % 11 != 0, F.sqrt(c("id") * 104_729 % 50_021)).alias("x")).cache()


def test_united_sketches_count_as_one(daily):
    stored = sketches.distinct_sketches(daily, ["station_id", "day"], "v")
    near = {r.station_id: r.n for r in sketches.distinct_counts(stored, ["station_id"]).collect()}
    whole = {r.station_id: r.n for r in sketches.distinct_counts(sketches.distinct_sketches(daily, ["station_id"], "v"), ["station_id"]).collect()}
    exact = {r.station_id: r.n for r in daily.groupBy("station_id").agg(F.countDistinct("v").alias("n")).collect()}
    for s, n in exact.items():
        assert abs(near[s] - n) <= 0.02 * n and abs(whole[s] - near[s]) <= 0.01 * n
    # united in two steps, they estimate as well as united in one
    half = sketches.united(stored.withColumn("part", c("day") % 2), ["station_id", "part"])
    for r in sketches.distinct_counts(half, ["station_id"]).collect():
        assert abs(r.n - exact[r.station_id]) <= 0.02 * exact[r.station_id]


def test_fences_from_stored_days(spark, daily, tmp_path):
    """A day is added without the others being read: its own file is all that the last run opens."""
    path = str(tmp_path / "sketches")
    for day in range(20):
        rows = daily.where(c("day") == day) if day < 2 or day == 19 else daily.where((c("day") == day) & (c("x") > -1))
        sketches.quantile_sketches(rows, ["station_id", "day"], "x").write.mode("append").parquet(path)
    fences = {r.station_id: r for r in sketches.fences(spark.read.parquet(path), ["station_id"]).collect()}
    for s, f in fences.items():
        mine = daily.where((c("station_id") == s) & c("x").isNotNull())
        n = mine.count()
        assert f.n == n and f.lower == pytest.approx(f.q1 - 1.5 * (f.q3 - f.q1)) and f.upper == pytest.approx(f.q3 + 1.5 * (f.q3 - f.q1))
        for q, share in ((f.q1, 0.25), (f.q3, 0.75)):
            assert abs(mine.where(c("x") <= q).count() - share * n) <= 0.01 * n


# ---- replaced days


def months(path):
    """Newest change of each folder with rows, and the files in it."""
    return {os.path.relpath(d, path): sorted((n, os.path.getmtime(f"{d}/{n}")) for n in names if n.endswith(".parquet"))
            for d, _, names in os.walk(path) if "_manifest" not in d and any(n.endswith(".parquet") for n in names)}


def test_replaced_days(spark, tmp_path, rows):
    path = str(tmp_path / "store")

    def days(first, n, value):
        return spark.range(n * 2).select(
            F.concat(F.lit("00"), (c("id") % 2).cast("string")).alias("station_id"),
            F.expr(f"cast('{first}' as timestamp_ntz) + make_dt_interval(cast(id div 2 as int))").alias("ts"), F.lit(value).alias("pm25"))

    def stored():
        df = spark.read.schema("station_id string, ts timestamp_ntz, pm25 double, date date, year int, month int").parquet(path)
        return rows(df, "station_id", "ts", "pm25")

    assert tables.replace_days(days("2024-01-01", 40, 1.0), path).count() == 4
    begun, before = months(path), stored()
    assert len(begun) == 4 and len(before) == 80
    # one day of one station: only that station's month is rewritten, and its other days stay
    one = days("2024-02-03", 1, 9.0).where("station_id = '001'")
    first = rows(tables.replace_days(one, path), "station_id", "month", "rows")
    assert first == [("001", 2, 9)]
    now = months(path)
    assert [d for d in begun if now[d] != begun[d]] == ["station_id=001/year=2024/month=2"]
    after = stored()
    assert len(after) == 80 and [r for r in after if r[2] == 9.0] == [r for r in after if r[0] == "001" and str(r[1])[:10] == "2024-02-03"]
    # again, with the same result
    tables.replace_days(one, path)
    assert stored() == after
    # a run that fails changes nothing
    held = months(path)
    broken = days("2024-01-05", 1, 5.0).withColumn("pm25", F.when(c("station_id") == "001", F.raise_error(F.lit("broken reading")).cast("double")).otherwise(c("pm25")))
    with pytest.raises(Exception, match="broken reading"):
        tables.replace_days(broken, path)
    assert stored() == after and months(path) == held
    manifest = {(r.station_id, r.month): (r.rows, str(r.first_day)) for r in tables.read_manifest(spark, path).collect()}
    assert manifest == {("000", 1): (31, "2024-01-01"), ("000", 2): (9, "2024-02-01"), ("001", 1): (31, "2024-01-01"), ("001", 2): (9, "2024-02-01")}


# ---- rejected records


def test_no_landed_line_is_lost(spark, tmp_path):
    """Broken lines, wrong types, missing times and values: each is counted once, with its text."""
    good = '{"station_id": "1", "parameter_name": "co", "value": %s, "datetime": {"utc": "2024-01-01T0%d:00:00Z"}}'
    lines = [good % (1.5, i) for i in range(5)] + [
        good[:40], "not json", '{"station_id": "1", "value": "high", "datetime": {"utc": "2024-01-01T01:00:00Z"}}',
        good % ("null", 3), '{"station_id": "1", "value": 2.0}', '{"station_id": "1", "value": 2.0, "datetime": {"utc": "soon"}}']
    (tmp_path / "m.json").write_text("\n".join(lines))
    read = landed.read_checked(spark, str(tmp_path / "m.json"), landed.MEASUREMENT_JSON)
    out = [(r.reason, r.record) for r in landed.rejects(read, landed.measurement_reasons()).collect()]
    assert sorted(r for r, _ in out) == ["malformed"] * 3 + ["no time", "no value", "unreadable time"]
    assert {t for r, t in out if r == "malformed"} == set(lines[5:8]) and any('"soon"' in t for _, t in out)
    assert landed.measurements(read).count() + len(out) == len(lines)
