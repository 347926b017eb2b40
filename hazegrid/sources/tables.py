"""Result tables: partitioned and plain Parquet, CSV, JSON and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from hazegrid.operators.lookup import join_on
from hazegrid.session import cut_lineage


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet with the station id as text, also where it is a folder name such as
    ``station_id=007``: a declared schema or disabled partition inference keeps it so."""
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    df = spark.read.parquet(path)
    return df.withColumn("station_id", F.col("station_id").cast("string"))


def write_by_station_month(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Partition by station, year and month.

    Rebalancing gathers the rows of a folder for few, large files; adaptive execution then
    splits what has become too large, so a station with very many rows has many writers.
    """
    dated = df.withColumns({"date": F.to_date(ts), "year": F.year(ts), "month": F.month(ts)})
    keys = ["station_id", "year", "month"]
    dated.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


MANIFEST = "station_id string, year int, month int, rows long, first_day date, last_day date, written timestamp"


def replace_days(df: DataFrame, path: str, ts: str = "ts") -> DataFrame:
    """Put the days of `df` into the store that `write_by_station_month` lays out; returns the manifest entries of this run.

    Of the stored rows, those of a station and date that `df` has are replaced; the station's other days in the same month stay. Only the folders of those
    station-months are read and rewritten. What they will hold is written to the shared folder first, and Spark puts the new folders in place only when
    all of them are written, so a run that fails leaves the old rows, and one that is repeated gives the same rows. The manifest below ``_manifest``
    (which reads of the store skip) then gets one entry per folder written.
    """
    spark = df.sparkSession
    keys = ["station_id", "year", "month"]
    new = df.withColumns({"date": F.to_date(ts), "year": F.year(ts), "month": F.month(ts)})
    new = cut_lineage(new, "days")
    touched = new.select(*keys).distinct()
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        old = spark.createDataFrame([], new.schema)
    # the folders to read are named by the join; days that come anew are left out
    kept = join_on(join_on(old, touched, keys, "left_semi"), new.select("station_id", "date").distinct(), ["station_id", "date"], "left_anti")
    merged = cut_lineage(kept.unionByName(new), "months")
    (merged.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))
    entries = cut_lineage(merged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
    ).withColumn("written", F.current_timestamp()), "manifest")
    entries.write.mode("append").parquet(f"{path}/_manifest")
    return entries


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest entry of every station-month of a store."""
    entries = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    newest = entries.groupBy("station_id", "year", "month").agg(F.max(F.struct("written", "rows", "first_day", "last_day")).alias("e"))
    return newest.select("station_id", "year", "month", "e.rows", "e.first_day", "e.last_day", "e.written")


def write_by_month(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Partition by year and month, rebalanced in the same way."""
    dated = df.withColumns({"year": F.year(ts), "month": F.month(ts)})
    dated.hint("rebalance", "year", "month").write.mode("overwrite").partitionBy("year", "month").parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header and one file per task; nothing is gathered on the driver."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header; a path that does not exist gives an empty table."""
    try:
        return spark.read.option("header", True).schema(schema).csv(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# Without these, JSON keeps milliseconds only.
JSON_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**JSON_TIMES).json(path)


def write_metadata(spark: SparkSession, path: str, **facts) -> None:
    """One JSON record of job facts such as the model name, its features and errors."""
    from pyspark.sql import Row

    spark.createDataFrame([Row(**facts)]).write.mode("overwrite").json(path)


def as_view(df: DataFrame, name: str) -> str:
    df.createOrReplaceTempView(name)
    return name


def export_view(df: DataFrame) -> DataFrame:
    """The fact table with the aliases and calendar columns that reports expect."""
    from hazegrid.functions.calendar import season

    return df.withColumns({
        "name": F.col("station_name"), "hour": F.hour("ts"), "month": F.month("ts"),
        "season": season(F.month("ts"))})


def with_provenance(df: DataFrame, **flags: bool | Column) -> DataFrame:
    """Columns that say where a part of the row came from: one answer for all rows, or a condition on each."""
    return df.withColumns({name: value if isinstance(value, Column) else F.lit(value) for name, value in flags.items()})
