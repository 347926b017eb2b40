"""Exact deduplication by Grace hashing: partition until a bucket fits, then compare complete contents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm.common import slices, without
from hazegrid.session import scratch_path

BUCKET_BYTES = 32 << 20
# A bucket of so few records is compared as it is, however long they are.
FEW = 16


def normalised(text: Column) -> Column:
    """Each run of space, \\t \\n \\v \\f \\r as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


class ContentTable:
    """Open addressing with linear probing. Equal hashes count for nothing: contents are compared."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.slots, self.hashes, self.texts, self.owners, self.bytes = [-1] * 64, [], [], [], 0

    def _slot(self, h: int, text: str | None) -> int:
        mask = len(self.slots) - 1
        i = h & mask
        while (j := self.slots[i]) >= 0 and not (text is not None and self.hashes[j] == h and self.texts[j] == text):
            i = (i + 1) & mask
        return i

    def owner(self, h: int, text: str, row: int) -> int:
        """The row that first brought this content; `row` itself if it is new."""
        i = self._slot(h, text)
        if self.slots[i] >= 0:
            return self.owners[self.slots[i]]
        self.slots[i] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.owners.append(row)
        self.bytes += len(text)
        if 3 * len(self.texts) > 2 * len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for j, g in enumerate(self.hashes):
                self.slots[self._slot(g, None)] = j
        return row


def _combine(limit: int, schema: T.StructType):
    """First pass, within a task: copies point to the first row with their content, and only that row keeps its `text`.
    The table starts again when it is full, so a task's memory is bounded; copies that this parts meet later."""
    def run(batches):
        found = ContentTable()
        for batch in batches:
            for part in slices(batch, "text"):
                if found.bytes > limit:
                    found.clear()
                rows, hashes, texts = (part.column(c).to_pylist() for c in ("row", "h", "text"))
                owners = [found.owner(h, t, r) for h, t, r in zip(hashes, texts, rows, strict=True)]
                new = {"owner": pa.array(owners, pa.int64())}
                if "text" in schema.names:
                    new["text"] = pa.array([t if o == r else None for o, r, t in zip(owners, rows, texts, strict=True)], part.column("text").type)
                yield pa.RecordBatch.from_arrays([new[n] if n in new else part.column(n) for n in schema.names], names=schema.names)
    return run


def _compare(bucket: pa.Table) -> pa.Table:
    bucket = bucket.sort_by("row")
    found = ContentTable()
    rows = bucket.column("row").to_pylist()
    owners = [found.owner(h, t, r) for h, t, r in zip(bucket.column("h").to_pylist(), bucket.column("text").to_pylist(), rows, strict=True)]
    return pa.table({"row": pa.array(rows, pa.int64()), "owner": pa.array(owners, pa.int64())})


def _buckets(records: DataFrame, limit: int) -> DataFrame:
    """The records with the bucket each belongs to: partitioned by hash, and the buckets beyond `limit` bytes
    by another hash again, until each fits, is one hash, or is few records. Sizes are summed without reading texts."""
    total = records.agg(F.sum("bytes")).first()[0] or 0
    out = records.withColumn("bucket", F.pmod("h", F.lit(2 * (total // limit) + 1)))
    level = 0
    while True:
        level += 1
        large = (out.groupBy("bucket").agg(F.sum("bytes").alias("all"), F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
                 .where((F.col("all") > limit) & (F.col("n") > FEW) & (F.col("low") != F.col("high")))
                 .select(F.col("bucket").alias("of"), (2 * F.ceil(F.col("all") / limit)).alias("parts")))
        if large.isEmpty():
            return out
        part = F.pmod(F.xxhash64("h", F.lit(level)), F.col("parts"))
        out = (out.join(large, out.bucket == large.of, "left")
               .withColumn("bucket", F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", part)))
               .drop("of", "parts"))


def _owners(records: DataFrame, limit: int) -> DataFrame:
    """row and owner for each record (row, h, bytes, text). Where one hash alone is beyond `limit`, its records are
    first dealt to parts by row, and only the part's owners meet in the next round."""
    spark = records.sparkSession
    bucketed = _buckets(records, limit)
    hot = (bucketed.groupBy("bucket").agg(F.sum("bytes").alias("all"), F.count("*").alias("n"))
           .where((F.col("all") > limit) & (F.col("n") > FEW))
           .select(F.col("bucket").alias("of"), F.least(F.ceil(F.col("all") / limit), F.ceil(F.col("n") / FEW)).alias("parts")))
    if hot.isEmpty():
        return bucketed.groupBy("bucket").applyInArrow(_compare, "row long, owner long")
    salted = bucketed.join(hot, bucketed.bucket == hot.of, "left").withColumn(
        "bucket", F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.pmod(F.xxhash64("row"), F.col("parts")))))
    path = scratch_path(spark, "owners")
    salted.groupBy("bucket").applyInArrow(_compare, "row long, owner long").write.parquet(path)
    near = spark.read.parquet(path)
    left = records.join(near.where("row = owner").select(F.col("row").alias("r")), F.col("row") == F.col("r"), "left_semi")
    far = _owners(left, limit).select(F.col("row").alias("near_owner"), F.col("owner").alias("far_owner"))
    return near.join(far, near.owner == far.near_owner).select("row", F.col("far_owner").alias("owner"))


def _resolve(df: DataFrame, id_col: str, text_col: str, limit: int, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The spill files, and per owner row (near) the first of its group and the group's size. With `carry`, the spill files hold those
    columns (c0, c1, ...) of every row, the text among them; without, only the normalised text of each owner."""
    spark = df.sparkSession
    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), normalised(F.col(f"`{text_col}`")).alias("text"), *carried)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("h"),
                       F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("text_sha256"), "text", *[f"c{i}" for i in range(len(carry))])
    kinds = {f.name: f.dataType for f in rows.schema.fields} | {"owner": T.LongType()}
    names = ["row", "doc_id", "h", "bytes", "owner"] + ([f"c{i}" for i in range(len(carry))] if carry else ["text_sha256", "text"])
    schema = T.StructType([T.StructField(n, kinds[n]) for n in names])
    path = scratch_path(spark, "spill")
    rows.mapInArrow(_combine(limit, schema), schema).write.option("compression", "zstd").parquet(path)
    spill = spark.read.schema(schema).parquet(path)

    text = normalised(F.col(f"c{carry.index(text_col)}")) if carry else F.col("text")
    owners = _owners(spill.where("row = owner").select("row", "h", "bytes", text.alias("text")), limit)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    members = spill.groupBy("owner").agg(F.min(first).alias("first"), F.count("*").alias("n")).withColumnRenamed("owner", "near")
    classes = members.join(owners.select(F.col("row").alias("r"), "owner"), F.col("near") == F.col("r")).select("near", "owner", "first", "n")
    whole = classes.groupBy("owner").agg(F.min("first").alias("first"), F.sum("n").alias("group_size")).withColumnRenamed("owner", "o")
    known = classes.select("near", "owner").join(whole, F.col("owner") == F.col("o")).select("near", "first", "group_size")
    return spill, known


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row.

    Copies within a task are combined before anything is shuffled, so that a text that a third of all rows
    share reaches its bucket once per task, not once per row. What is left is written to the shared folder as spill
    files and partitioned recursively until each bucket holds at most `limit` bytes; a task then compares complete contents
    in an open-addressing table. Sizes of groups are summed per task first. Runs jobs.

    Null texts count as empty, and all empty texts are equal. Null ids rank last; a group of null ids only has
    keep_id null. Of repeated rows (same id and text) exactly one is kept. An empty table gives an empty result. Other columns are ignored."""
    spill, known = _resolve(df, id_col, text_col, limit, [])
    return (spill.select("row", "doc_id", "owner", "text_sha256").join(known, F.col("owner") == F.col("near"))
            .select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"))


def distinct_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BUCKET_BYTES) -> DataFrame:
    """The rows that `exact_dedup` keeps, with all their columns. The spill files hold whole rows here; dropped rows are taken out
    by their numbers. Runs jobs."""
    spill, known = _resolve(df, id_col, text_col, limit, df.columns)
    out = (spill.select("row", "owner").join(known, F.col("owner") == F.col("near")).where(F.col("row") != F.col("first.row"))
           .select(F.col("row").alias("r")))
    left = without(spill, out, "row", "r")
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])


ORACLE = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents),
g as (select body, min(doc_id) as keep_id, count(*) as group_size from t group by body)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.body) as text_sha256
from t join g on t.body = g.body
"""
