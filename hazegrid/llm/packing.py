"""Best-fit packing of documents into sequences, after Martello and Toth's dominance reduction."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm import bpe
from hazegrid.llm.common import map_texts
from hazegrid.session import cut_lineage

ROWS_PER_BUCKET = 20_000


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0,
           vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and `end_id`, cut only where longer than
    `capacity`. A null or empty text is the end id alone."""

    def make():
        def cut(texts):
            out = []
            for ids in bpe.words(vocabulary).ids(texts):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                out.append([(a // capacity, a, len(p := ids[a:a + capacity]), crc32(p.tobytes()))
                            for a in range(0, len(ids), capacity)])
            return [out]
        return cut

    cut = map_texts(df, {id_col: "doc_id"}, text_col,
                    "cuts array<struct<piece:int,start:long,length:long,ids_crc32:long>>", make)
    return cut.select("doc_id", F.inline("cuts"))


class Plan:
    """Where the items of each length go. `add` sends the next `n` items of one length to bins that follow one
    another from `first`, `each` to a bin, at `offset`."""

    def __init__(self):
        self.used: dict[int, int] = {}
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.bins = 0

    def open(self, n: int) -> int:
        first, self.bins = self.bins, self.bins + n
        return first

    def add(self, length: int, n: int, first: int, each: int, offset: int) -> None:
        begun = self.used.get(length, 0)
        self.rows.append((length, begun, first, each, offset))
        self.used[length] = begun + n


def reduce_dominated(count: dict[int, int], capacity: int, plan: Plan) -> dict[int, int]:
    """Fix bins that dominate every other bin their largest item could be in, and return what is left.

    For an item j, with the lengths that still fit beside it: alone if none fits; with the longest that fits if it
    fills the bin, or if no two others fit together; with the longest a and the next that fits, b, if no three
    fit and no fitting pair has a smaller item longer than b. Equal items are fixed together."""
    left = dict(count)

    def fits(room: int, taken: list[int]) -> int | None:
        return next((x for x in sorted(left, reverse=True) if x <= room and left[x] > taken.count(x)), None)

    def smallest(k: int, taken: list[int]) -> int:
        total = 0
        for x in sorted(left):
            m = min(k, left[x] - taken.count(x))
            if m > 0:
                total, k = total + m * x, k - m
            if not k:
                return total
        return capacity + 1

    for j in sorted(count, reverse=True):
        while left.get(j):
            room = capacity - j
            a = fits(room, [j])
            if a is None:
                group = [j]
            elif a == room or smallest(2, [j]) > room:
                group = [j, a]
            else:
                b = fits(room - a, [j, a])
                half = fits(room // 2, [j])
                if b is None or smallest(3, [j]) <= room or half is None or half > b:
                    break
                group = [j, a, b]
            n = min(left[x] // group.count(x) for x in group)
            first, offset = plan.open(n), 0
            for x in dict.fromkeys(group):
                each = group.count(x)
                plan.add(x, n * each, first, each, offset)
                offset += each * x
                left[x] -= n * each
                if not left[x]:
                    del left[x]
    return left


def best_fit(count: dict[int, int], capacity: int, plan: Plan) -> None:
    """Longest items first, each into the fullest bin it fits. Bins alike are kept as ranges of bin numbers."""
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for length in sorted(count, reverse=True):
        n = count[length]
        room = length
        while n:
            while room <= capacity and not free[room]:
                room += 1
            if room > capacity:
                each = capacity // length
                new = -(-n // each)
                free[capacity].append((plan.open(new), new))
                room = capacity
            first, bins = free[room].pop()
            each = min(room // length, n)
            took = min(bins, n // each)
            plan.add(length, took * each, first, each, capacity - room)
            n -= took * each
            free[room - each * length].append((first, took))
            if took < bins:
                free[room].append((first + took, bins - took))


def pack_lengths(count: dict[int, int], capacity: int) -> Plan:
    """A plan for so many items of each length. Its work and size depend on the capacity, not on the number of items."""
    plan = Plan()
    best_fit(reduce_dominated(count, capacity, plan), capacity, plan)
    return plan


def best_fit_packing(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
                     end_id: int = 0, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document.

    Items of one length are interchangeable, so the packing is solved on the counts per length: at most
    `capacity` numbers reach the driver, however many documents there are. Each piece then finds its
    place by its rank among the pieces of its length; ranks come from counts per bucket, so that a
    length that a third of all pieces share is spread over many tasks. Runs jobs: the pieces (without
    texts) are written to the shared folder first.

    A null or empty text is one piece of length 1. Repeated rows are packed as often as they occur, ties in
    any order; an empty table gives no pieces. Other columns are ignored."""
    spark = df.sparkSession
    cut = cut_lineage(pieces(df, id_col, text_col, capacity, end_id, vocabulary), "pieces")
    count = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = pack_lengths(count, capacity)
    buckets = max(16, sum(count.values()) // ROWS_PER_BUCKET)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        F.col("length").alias("l"), F.col("bucket").alias("b"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (dealt.withColumn("rank", F.row_number().over(order) - 1)
              .join(before, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b")))
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank")))
    parts = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    schema = T.StructType(ranked.schema.fields[:5] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        # Length and rank in one number; ranks are below 2^48.
        begins = (parts[:, 0] << 48) + parts[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = parts[np.searchsorted(begins, (length << 48) + rank, side="right") - 1]
            nth = rank - at[:, 1]
            bins, offset = at[:, 2] + nth // at[:, 3], at[:, 4] + nth % at[:, 3] * length
            yield pa.RecordBatch.from_arrays([b.column(c) for c in schema.names[:5]] + [pa.array(bins), pa.array(offset)], names=schema.names)

    if not count:
        return spark.createDataFrame([], schema)
    return ranked.mapInArrow(place, schema)
