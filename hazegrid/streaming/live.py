"""Live readings. Every transformation takes a batch or a streaming DataFrame alike."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.functions import aqi

VALID_RANGE = (1.0, 900.0)     # fixed values: plausible live PM2.5


def timed(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as TIMESTAMP, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def latest_valid(readings: DataFrame, parameter: str = "pm25") -> DataFrame:
    """Newest plausible value per station; of several at one time, the largest."""
    ok = readings.where((F.col("parameter") == parameter) & F.col("value").between(*VALID_RANGE))
    return ok.groupBy("station_id").agg(F.max(F.struct("ts", "value")).alias("_r")).select("station_id", "_r.ts", "_r.value")


def hourly_means(readings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Mean per station, parameter and clock hour."""
    return readings.withWatermark("ts", delay).groupBy(
        "station_id", "parameter", F.window("ts", "1 hour").alias("w"),
    ).agg(F.avg("value").alias("mean_value"), F.count("value").alias("n")).select(
        "station_id", "parameter", F.col("w.start").alias("hour_start"), "mean_value", "n")


def daily_means_hourly(readings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Mean over the last 24 hours, updated every hour.

    Hours are summed first, so 24 overlapping windows share hourly sums instead of each
    taking every reading.
    """
    hours = readings.withWatermark("ts", delay).groupBy(
        "station_id", "parameter", F.window("ts", "1 hour").alias("h"),
    ).agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    return hours.groupBy(
        "station_id", "parameter", F.window(F.window_time("h"), "24 hours", "1 hour").alias("w"),
    ).agg(F.sum("total").alias("total"), F.sum("n").alias("n")).select(
        "station_id", "parameter", F.col("w.end").alias("window_end"),
        F.try_divide("total", "n").alias("mean_value"), "n")


def without_repeats(readings: DataFrame, key: str | list[str] = "event_id", delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of an event that arrive within the delay; state older than that is freed."""
    keys = [key] if isinstance(key, str) else key
    out = readings.withWatermark("ts", delay)
    return out.dropDuplicatesWithinWatermark(keys) if readings.isStreaming else out.dropDuplicates(keys)


def hourly_aqi(readings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Index and category of the hourly PM2.5 means."""
    hourly = hourly_means(readings.where(F.col("parameter") == "pm25"), delay)
    index = aqi.index_ceiling(F.col("mean_value"))
    return hourly.withColumn("aqi", index).withColumn("aqi_cat", aqi.category(F.col("aqi")))


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Process what is there in append mode and return all rows emitted so far.

    `path` holds the rows and, in `state`, the checkpoint. A later call with the same path takes up only what has
    arrived since; both folders belong on storage that outlives the application.
    """
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def run_updates(stream: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Process what is there in update mode and return the newest row per key.

    Every batch overwrites its own folder below `path`, so a batch that is tried again leaves no repeats, and a later
    call with the same path goes on after the last batch.
    """
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/part={batch_id}")

    query = (
        stream.writeStream.foreachBatch(put).outputMode("update")
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType(stream.schema.fields + [T.StructField("batch", T.LongType())])
    rest = [c for c in stream.columns if c not in keys]
    try:
        rows = stream.sparkSession.read.schema(schema).parquet(f"{path}/rows/*")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = stream.sparkSession.createDataFrame([], schema)      # nothing has arrived yet
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(*keys, "_r.*")
