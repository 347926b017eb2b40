"""Shared steps of the operators: whole texts through Arrow batches, and small prefix sums."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.session import cut_lineage

SLICE_BYTES = 4 << 20
BATCH_ROWS = 1_000
# Rows of one or two numbers up to which a list is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 500_000


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about SLICE_BYTES of `column`; a longer value is a part of its own."""
    if batch.num_rows == 0:
        return
    texts = batch.column(column)
    if texts.nbytes <= SLICE_BYTES:
        yield batch
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    begun, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(begun, i - begun)
            begun, held = i, 0
        held += n
    yield batch.slice(begun)


def map_texts(df: DataFrame, keep: dict[str, str], text_col: str, added: str,
              make: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """A row per input row: the `keep` columns under their new names, and the columns of the DDL `added` that
    `make()(texts)` returns as Arrow arrays or lists. Null texts come as empty. `make` runs once per task."""
    own = [] if text_col in keep else [F.col(f"`{text_col}`").cast("string").alias("__text")]
    source = df.select(*[F.col(f"`{c}`").alias(n) for c, n in keep.items()], *own)
    text = keep.get(text_col, "__text")
    fields = source.schema.fields[:len(keep)] + T.StructType.fromDDL(added).fields
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    kept = list(keep.values())

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        types = [arrow.field(n).type for n in schema.names[len(kept):]]
        apply = make()
        for batch in batches:
            for part in slices(batch, text):
                new = [x if isinstance(x, pa.Array) else pa.array(x, t)
                       for x, t in zip(apply([t or "" for t in part.column(text).to_pylist()]), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + new, names=schema.names)

    return source.mapInArrow(run, schema)


def without(df: DataFrame, dropped: DataFrame, key: str, dropped_key: str) -> DataFrame:
    """Rows of `df` whose key is not in `dropped`, which is written to the shared folder and counted first: a short
    list is broadcast, a long one shuffled. Runs a job."""
    dropped = cut_lineage(dropped.select(dropped_key), "dropped")
    side = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    return df.join(side, F.col(key) == F.col(dropped_key), "left_anti")


def prepare(spark: SparkSession) -> None:
    """Tell Python workers where the driver found this package; a session started elsewhere may not have it on its path.
    Rows with whole texts travel in batches of at most BATCH_ROWS, so that a task holds a few megabytes of them at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
