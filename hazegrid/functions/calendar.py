"""Calendar columns and seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.schema import SEASON_MONTHS, SEASONS


def hour_of(ts: Column) -> Column:
    """Start of the hour as TIMESTAMP_NTZ (``date_trunc`` alone returns TIMESTAMP)."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def season(month: Column) -> Column:
    """Season name of a month number; null stays null."""
    return by_season(month, {name: name for name in SEASONS})


def by_season(month: Column, values: dict) -> Column:
    """The value that `values` gives for the season of a month number."""
    first, *others = SEASONS
    expr = F.when(month.isin(*SEASON_MONTHS[first]), values[first])
    for name in others:
        expr = expr.when(month.isin(*SEASON_MONTHS[name]), values[name])
    return expr


def season_code(name: Column) -> Column:
    """Position of the season in the year's order, 0 to 3."""
    expr = F.when(name == SEASONS[0], 0)
    for i, s in enumerate(SEASONS[1:], start=1):
        expr = expr.when(name == s, i)
    return expr


def day_type(dow: Column, weekend: tuple[int, ...] = (1, 7)) -> Column:
    """Weekend or Weekday; days count from 1 = Sunday. Pass ``weekend=(6, 7)`` for Fri/Sat."""
    return F.when(dow.isin(*weekend), "Weekend").when(dow.isNotNull(), "Weekday")


def parse_utc(text: Column) -> Column:
    """Timestamp of ``2024-01-31T05:00:00Z``; null when the text does not parse."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("timestamp_ntz")


def with_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add hour, dow (1 = Sunday), day, month, year, date, season and season_code."""
    t = F.col(ts)
    return df.withColumns({
        "hour": F.hour(t),
        "dow": F.dayofweek(t),
        "day": F.dayofmonth(t),
        "month": F.month(t),
        "year": F.year(t),
        "date": F.to_date(t),
        "season": season(F.month(t)),
    }).withColumn("season_code", season_code(F.col("season")))
