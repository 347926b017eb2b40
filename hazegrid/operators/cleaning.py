"""Deduplication, gap filling, outlier handling and the wide reading table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions.calendar import hour_of
from hazegrid.functions.units import to_mass_units, within_physical_range, TARGET_UNIT
from hazegrid.operators.lookup import dedupe, join_on
from hazegrid.operators.ordering import GROUP_ROWS, by_group_size, last_known, last_known_in_pieces, last_known_whole, over_rows
from hazegrid.session import cut_lineage
from hazegrid.schema import CLEANED, CLIP_K, FILL_HOURS, FILL_ROWS, FLAG_K, POLLUTANTS, normalize


# Accuracy of the mergeable quantile sketch: exact for groups of up to so many rows, and off by
# at most a ten-thousandth of the ranks beyond.
SKETCH = 10_000


def filled_count(cols: list[str]) -> Column:
    """How many of the columns are present in a row."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])


# ---- shape ------------------------------------------------------------------------------

def widen(readings: DataFrame, keys: list[str], parameter: str = "parameter", value: str = "value") -> DataFrame:
    """Long readings to one row per key with a mean per pollutant; all six columns exist.

    Six conditional means share one shuffle of combined partial sums; a ``pivot`` shuffles
    twice.
    """
    return readings.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(parameter) == p, F.col(value))).alias(p) for p in POLLUTANTS])


def hourly_wide(readings: DataFrame) -> DataFrame:
    """Mean per station, hour and pollutant."""
    return widen(readings.withColumn("ts", hour_of(F.col("ts"))), ["station_id", "ts"])


def standardise(readings: DataFrame) -> DataFrame:
    """Values in mass units and physically possible, in one projection."""
    value = to_mass_units(F.col("value"), F.col("unit"), F.col("parameter"))
    return readings.withColumns({
        "value": within_physical_range(value, F.col("parameter")),
        "unit": F.lit(TARGET_UNIT),
    })


# ---- duplicates -------------------------------------------------------------------------

def deduplicate(
    df: DataFrame, keys: list[str] = ["ts", "station_id"], cols: list[str] = POLLUTANTS,
    tie_break: list[str] = [],
) -> DataFrame:
    """Keep, per station and time, the row with the most pollutants present; ties go to the
    smallest `tie_break` columns and then to the smallest remaining values.

    The time comes first in the key: it tells most rows apart, which makes sorting cheaper.
    """
    return dedupe(df, keys, [-filled_count(cols), *[F.col(c) for c in tie_break]])


# ---- gaps -------------------------------------------------------------------------------

def carry_forward_hours(df: DataFrame, cols: list[str], hours: float = FILL_HOURS) -> DataFrame:
    """Fill a null with the station's last value if that is at most `hours` old. All columns share one window. Runs the jobs of `last_known`."""
    return last_known(df, ["station_id"], "ts", cols, hours)


def carry_forward_rows(
    long: DataFrame, value: str = "value", rows: int = FILL_ROWS, order: list[str] = ["ts"],
) -> DataFrame:
    """Fill a null with the last value among the `rows` readings before it, per station and
    parameter."""
    return over_rows(
        long, ["station_id", "parameter"], [F.col(c) for c in order],
        lambda w: {value: F.last(value, ignorenulls=True).over(w.rowsBetween(-rows, 0))}, before=rows,
    )


def hour_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """Median of each column per station and hour of day, all in one aggregation."""
    return df.groupBy("station_id", F.hour("ts").alias("hour")).agg(
        *[F.percentile_approx(c, 0.5, SKETCH).alias(f"median_{c}") for c in cols])


def fill_from_hour_medians(df: DataFrame, cols: list[str], medians: DataFrame | None = None) -> DataFrame:
    """Replace remaining nulls by the station's median for that hour of day."""
    medians = hour_medians(df, cols) if medians is None else medians
    joined = join_on(df.withColumn("hour", F.hour("ts")), medians, ["station_id", "hour"])
    return joined.select(*[
        F.coalesce(F.col(c), F.col(f"median_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def fill_gaps(df: DataFrame, cols: list[str], hours: float = FILL_HOURS, most: int = GROUP_ROWS) -> DataFrame:
    """Carry forward up to `hours`, then fill from hour medians of the carried values. `df` is written to the shared folder, as its stations
    are counted before; stations of more than `most` rows go in pieces. Runs those jobs."""
    return by_group_size(
        cut_lineage(df, "rows"), ["station_id"], lambda rows: _filled_whole(rows.repartition("station_id"), cols, hours),
        lambda rows: _filled_in_pieces(rows, cols, hours), most)


def _filled_whole(df: DataFrame, cols: list[str], hours: float = FILL_HOURS) -> DataFrame:
    """Filled rows of stations that fit one task. `df` is partitioned by station, which serves both windows. Lazy."""
    carried = last_known_whole(df, ["station_id"], "ts", cols, hours).withColumn("_hour", F.hour("ts"))
    same_hour = Window.partitionBy("station_id", "_hour")
    known = F.col("station_id").isNotNull() & F.col("_hour").isNotNull()
    return carried.withColumns({
        c: F.coalesce(F.col(c), F.when(known, F.percentile_approx(c, 0.5, SKETCH).over(same_hour))) for c in cols}).drop("_hour")


def _filled_in_pieces(df: DataFrame, cols: list[str], hours: float = FILL_HOURS) -> DataFrame:
    """Filled rows of stations of any size. Carried rows and medians are written to the shared folder; medians of few stations are joined without a
    shuffle of the rows. Runs these jobs."""
    carried = cut_lineage(last_known_in_pieces(df, ["station_id"], "ts", cols, hours), "carried")
    return fill_from_hour_medians(carried, cols, cut_lineage(hour_medians(carried, cols), "medians"))


def day_medians(long: DataFrame, value: str) -> DataFrame:
    """Median per station, parameter and date."""
    return long.where(F.col(value).isNotNull()).groupBy(
        "station_id", "parameter", F.to_date("ts").alias("date"),
    ).agg(F.percentile_approx(value, 0.5, SKETCH).alias("daily_median"))


def fill_from_day_medians(long: DataFrame, value: str, medians: DataFrame) -> DataFrame:
    joined = join_on(long.withColumn("date", F.to_date("ts")), medians, ["station_id", "parameter", "date"])
    return joined.withColumn(value, F.coalesce(F.col(value), F.col("daily_median"))).drop("daily_median", "date")


def fill_gaps_long(long: DataFrame, order: list[str] = ["ts"], k: float = FLAG_K) -> DataFrame:
    """Outliers to null, carry forward up to three readings, then the day's median of the
    values that were there before filling. The flagged readings are read three times, so they
    are written to the shared folder; runs that job."""
    flagged = cut_lineage(flag_outliers(long, k=k), "flagged")
    medians = day_medians(flagged, "value_clean")
    carried = carry_forward_rows(flagged, "value_clean", order=order)
    return fill_from_day_medians(carried, "value_clean", medians)


# ---- outliers ---------------------------------------------------------------------------

def _fences(q1: Column, q3: Column, k: float) -> tuple[Column, Column]:
    return q1 - (q3 - q1) * k, q3 + (q3 - q1) * k


def quartile_fences(df: DataFrame, cols: list[str], k: float = CLIP_K, keys: list[str] = ["station_id"]) -> DataFrame:
    """q1, q3, lower and upper bound of every column, one row per key."""
    quartiles = df.groupBy(*keys).agg(
        *[F.percentile_approx(c, [0.25, 0.75], SKETCH).alias(f"_q_{c}") for c in cols])
    out = [F.col(key) for key in keys]
    for c in cols:
        q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        low, high = _fences(q1, q3, k)
        out += [q1.alias(f"q1_{c}"), q3.alias(f"q3_{c}"), low.alias(f"lower_{c}"), high.alias(f"upper_{c}")]
    return quartiles.select(*out)


def clip_outliers(df: DataFrame, cols: list[str] = POLLUTANTS, k: float = CLIP_K) -> DataFrame:
    """Bound each column by its station's fences; a column without fences is left alone.
    Reads `df` twice, for the fences and for the rows."""
    fences = quartile_fences(df, cols, k).select(
        "station_id", *[f"lower_{c}" for c in cols], *[f"upper_{c}" for c in cols])
    return _clipped(join_on(df, fences, ["station_id"]), cols, df.columns)


def _clipped(fenced: DataFrame, cols: list[str], columns: list[str]) -> DataFrame:
    """`columns` with `cols` bounded by their ``lower_`` and ``upper_`` columns."""
    return fenced.select(*[
        (F.when(F.col(c) < F.col(f"lower_{c}"), F.col(f"lower_{c}"))
         .when(F.col(c) > F.col(f"upper_{c}"), F.col(f"upper_{c}")).otherwise(F.col(c)).alias(c))
        if c in cols else F.col(c) for c in columns])


def reading_fences(long: DataFrame, value: str = "value", k: float = FLAG_K) -> DataFrame:
    """Bounds per station and parameter."""
    q = long.where(F.col(value).isNotNull()).groupBy("station_id", "parameter").agg(
        F.percentile_approx(value, [0.25, 0.75], SKETCH).alias("_q"))
    low, high = _fences(F.col("_q")[0], F.col("_q")[1], k)
    return q.select(
        "station_id", "parameter", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"),
        (F.col("_q")[1] - F.col("_q")[0]).alias("iqr"), low.alias("lower"), high.alias("upper"))


def flag_outliers(long: DataFrame, value: str = "value", k: float = FLAG_K) -> DataFrame:
    """Add ``is_outlier`` (never null) and ``value_clean``, which is null for outliers."""
    fences = reading_fences(long, value, k).select("station_id", "parameter", "lower", "upper")
    v = F.col(value)
    outside = F.coalesce((v < F.col("lower")) | (v > F.col("upper")), F.lit(False))
    return (
        join_on(long, fences, ["station_id", "parameter"])
        .withColumn("is_outlier", outside)
        .withColumn("value_clean", F.when(~F.col("is_outlier"), v))
        .drop("lower", "upper")
    )


def outlier_summary(flagged: DataFrame) -> DataFrame:
    """Valid and flagged counts and the spread of clean values per parameter."""
    return flagged.groupBy("parameter").agg(
        F.count("value_clean").alias("valid_records"),
        F.count_if("is_outlier").alias("outliers_flagged"),
        F.avg("value_clean").alias("mean"), F.stddev("value_clean").alias("std"),
        F.min("value_clean").alias("min"), F.max("value_clean").alias("max"))


# ---- whole store ------------------------------------------------------------------------

def enforce_schema(df: DataFrame) -> DataFrame:
    """Declared columns in order, float pollutants, everything else dropped."""
    with_dates = df.withColumns({
        "date": F.to_date("ts"), "year": F.year("ts"), "month": F.month("ts")})
    return normalize(with_dates, CLEANED)


def _fenced(df: DataFrame, cols: list[str], clipped: list[str], tie_break: list[str], k: float, most: int) -> DataFrame:
    """Deduplicated and filled rows with the fences of their station as ``lower_`` and ``upper_`` columns.

    The rows of a station that fits one task meet once, and every step is done there; only stations of more than `most` rows go
    in pieces, with the values between the steps written to the shared folder. `df` is read twice, first for the rows per station. Runs these jobs."""
    bounds = [f"{side}_{c}" for c in clipped for side in ("lower", "upper")]

    def whole(rows: DataFrame) -> DataFrame:
        filled = _filled_whole(deduplicate(rows.repartition("station_id"), tie_break=tie_break), cols)
        quartiles = filled.withColumns({f"_q_{c}": F.when(F.col("station_id").isNotNull(), F.percentile_approx(
            c, [0.25, 0.75], SKETCH).over(Window.partitionBy("station_id"))) for c in clipped})
        fences = [_fences(F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1], k) for c in clipped]
        return quartiles.select(*df.columns, *[side.alias(name) for name, side in zip(bounds, [b for pair in fences for b in pair])])

    def pieces(rows: DataFrame) -> DataFrame:
        filled = _filled_in_pieces(deduplicate(rows, tie_break=tie_break), cols)
        fences = cut_lineage(quartile_fences(filled, clipped, k).select("station_id", *bounds), "fences")
        return join_on(filled, fences, ["station_id"]).select(*df.columns, *bounds)

    return by_group_size(df, ["station_id"], whole, pieces, most)


def clean_store(df: DataFrame, cols: list[str], tie_break: list[str] = [], most: int = GROUP_ROWS) -> DataFrame:
    """Deduplicate, fill, clip, then project onto the documented table. Runs the job that counts the rows per station, and
    those for stations of more than `most` rows."""
    clipped = [c for c in POLLUTANTS if c in cols]
    return enforce_schema(_clipped(_fenced(df, cols, clipped, tie_break, CLIP_K, most), clipped, df.columns))


def cleaning_audit(before: DataFrame, tie_break: list[str] = [], cols: list[str] = POLLUTANTS,
                   k: float = CLIP_K, most: int = GROUP_ROWS) -> DataFrame:
    """Rows in and out of deduplication, and per column the nulls left and values clipped:
    one row per column, all columns counted in one pass. Runs the jobs of `clean_store`."""
    joined = _fenced(before, cols, cols, tie_break, k, most)
    counts = joined.agg(
        F.count(F.lit(1)).alias("rows_after"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in cols],
        *[F.count_if((F.col(c) < F.col(f"lower_{c}")) | (F.col(c) > F.col(f"upper_{c}"))).alias(f"clipped_{c}")
          for c in cols])
    total = before.agg(F.count(F.lit(1)).alias("rows_before"))
    per_column = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"nulls_{c}").alias("nulls_left"),
                 F.col(f"clipped_{c}").alias("values_clipped")) for c in cols])).alias("_c")
    return join_on(counts, total, []).select(
        (F.col("rows_before") - F.col("rows_after")).alias("duplicates_removed"), per_column,
    ).select("duplicates_removed", "_c.*")
