"""Token ids in files coded by a static range asymmetric numeral system (rANS).

A folder of token files holds

* `table/`: symbol and frequency, the shared table, whose frequencies add up to 2^BITS;
* `blocks/`: one row per block, as Parquet. A block holds whole documents and decodes on its own. It names its shard
  and number, the ids before it in the shard, its documents with their lengths, the number of interleaved lanes, the
  coded words, checkpoints, and the crc32 of the decoded ids and of the coded words;
* `shards/`: shard and number of ids. Shards ascend by document id, so that their running sum gives each its start.

Lane l of a block codes the ids l, l + lanes, l + 2 lanes, and so on. A checkpoint every EVERY steps keeps the lanes' states and the
place in the words, so that a reader may decode the parts of a block side by side, or only the part it wants.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm import bpe
from hazegrid.llm.common import map_texts
from hazegrid.session import scratch_path

BITS = 20
LOW = np.uint64(1 << 31)
LANES = 1024
EVERY = 256
BLOCK_IDS = 1 << 20
SHARD_IDS = 8 << 20
U = np.uint64


class Table:
    """Frequencies scaled to 2^BITS; every symbol that occurs keeps at least 1."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = np.asarray(symbols, np.uint32), np.asarray(freq, np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.int64)

    @classmethod
    def of(cls, symbols, counts) -> Table:
        counts = np.asarray(counts, np.float64)
        freq = np.maximum(1, np.floor(counts * ((1 << BITS) / counts.sum()))).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        over = int(freq.sum()) - (1 << BITS)
        if over < 0:
            freq[order[0]] -= over
        for k in order:
            if over <= 0:
                break
            cut = min(over, int(freq[k]) - 1)
            freq[k] -= cut
            over -= cut
        return cls(symbols, freq)

    def coder(self):
        """Frequency and begin by symbol."""
        if not hasattr(self, "_by_symbol"):
            n = int(self.symbols.max()) + 1
            f, c = np.zeros(n, U), np.zeros(n, U)
            f[self.symbols], c[self.symbols] = self.freq, self.begin
            self._by_symbol = f, c
        return self._by_symbol

    def decoder(self):
        """Row of the table by slot."""
        if not hasattr(self, "_by_slot"):
            self._by_slot = np.repeat(np.arange(len(self.freq)), self.freq)
        return self._by_slot


def encode(ids: np.ndarray, table: Table, lanes: int) -> tuple[bytes, list[tuple[int, int, bytes]]]:
    """The coded words, and the checkpoints (step, place in the words, states), the first at step 0."""
    freq, begin = table.coder()
    f_all, c_all = freq[ids], begin[ids]
    x = np.full(lanes, LOW, U)
    words, emitted, marks = [], 0, []
    for step in range(-(-len(ids) // lanes) - 1, -1, -1):
        f, c = f_all[step * lanes:(step + 1) * lanes], c_all[step * lanes:(step + 1) * lanes]
        xs = x[:len(f)]
        full = xs >= f << U(63 - BITS)
        if full.any():
            out = xs[full]
            words.append((out & U(0xFFFFFFFF)).astype("<u4"))
            emitted += len(out)
            xs[full] = out >> U(32)
        q = xs // f
        x[:len(f)] = (q << U(BITS)) + (xs - q * f) + c
        if step % EVERY == 0:
            marks.append((step, emitted, x.astype("<u8").tobytes()))
    coded = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    return coded.tobytes(), [(s, len(coded) - e, states) for s, e, states in reversed(marks)]


def decode(coded: bytes, marks: list, n_ids: int, table: Table, lanes: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block, or those from checkpoint `first` up to checkpoint `last`."""
    words = np.frombuffer(coded, "<u4").astype(U)
    row_of = table.decoder()
    freq, begin = table.freq.astype(U), table.begin.astype(U)
    step, at, states = marks[first]
    end = marks[last][0] if last is not None and last < len(marks) else -(-n_ids // lanes)
    x = np.frombuffer(states, "<u8").astype(U)
    out = np.empty(min(n_ids, end * lanes) - step * lanes, np.uint32)
    mask, done = U((1 << BITS) - 1), 0
    for s in range(step, end):
        k = min(lanes, n_ids - s * lanes)
        xs = x[:k]
        slot = xs & mask
        row = row_of[slot]
        xs[:] = freq[row] * (xs >> U(BITS)) + slot - begin[row]
        low = np.flatnonzero(xs < LOW)
        if len(low):
            xs[low] = (xs[low] << U(32)) | words[at:at + len(low)]
            at += len(low)
        out[done:done + k] = row
        done += k
    return table.symbols[out]


def _coded_ids(df: DataFrame, id_col: str, text_col: str, end_id: int, vocabulary: str) -> DataFrame:
    """doc_id, the number of ids, and the ids as compressed little-endian numbers, two bytes each where the vocabulary allows."""
    def make():
        narrow = "<u2" if max(bpe.library(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True)

        def ids(texts):
            all_ids = [np.append(x, np.uint32(end_id)).astype(narrow) for x in bpe.words(vocabulary).ids(texts)]
            return [[len(x) for x in all_ids], [x.itemsize for x in all_ids], [pack.compress(x.tobytes()) for x in all_ids]]
        return ids

    return map_texts(df, {id_col: "doc_id"}, text_col, "n long, width int, ids binary", make)


def _unpacked(batch: pa.RecordBatch):
    unpack = zstandard.ZstdDecompressor()
    for width, ids in zip(batch.column("width").to_pylist(), batch.column("ids").to_pylist(), strict=True):
        yield np.frombuffer(unpack.decompress(ids), f"<u{width}").astype(np.uint32)


def _symbol_counts(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for ids in _unpacked(batch):
            found = np.bincount(ids, minlength=len(total))
            found[:len(total)] += total
            total = found
    symbols = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(symbols), pa.array(total[symbols])], names=["symbol", "n"])


BLOCKS = ("shard int, block int, start long, n_ids long, doc_ids array<{id}>, doc_lengths array<long>, lanes int, "
          "coded binary, marks array<struct<step:int,at:int,states:binary>>, ids_crc32 long, coded_crc32 long")


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                      vocabulary: str = bpe.VOCABULARY) -> None:
    """Write the ids of all texts, each ended by `end_id`, in ascending order of `id_col`.

    Three jobs: texts are tokenised once and their packed ids written to the shared folder; symbols are counted per
    task and summed, which gives the driver at most one row per vocabulary entry; then the ids are
    dealt to shards by document id, sorted there, and coded block by block. A task holds one block. A document
    longer than a block is a block of its own.

    A null or empty text is the end id alone. Null ids come first; ties are ordered by their ids' bytes. Repeated
    rows are written as often as they occur. An empty table gives files without blocks. Other columns are ignored."""
    spark = df.sparkSession
    staged = scratch_path(spark, "ids")
    _coded_ids(df, id_col, text_col, end_id, vocabulary).write.option("compression", "uncompressed").parquet(staged)
    ids = spark.read.parquet(staged)
    counts = sorted((r["symbol"], r["n"]) for r in ids.select("width", "ids").mapInArrow(_symbol_counts, "symbol long, n long")
                    .groupBy("symbol").agg(F.sum("n").alias("n")).collect())
    id_type = ids.schema["doc_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(BLOCKS.format(id=id_type))
    shared = Table.of([s for s, _ in counts], [n for _, n in counts]) if counts else None
    spark.createDataFrame([(int(s), int(f)) for s, f in zip(shared.symbols, shared.freq, strict=True)] if counts else [],
                          "symbol long, freq long").coalesce(1).write.parquet(f"{path}/table")
    symbols, freq = (shared.symbols, shared.freq) if counts else (None, None)

    def code(batches):
        shard = TaskContext.get().partitionId()
        state = {"block": 0, "start": 0}

        def block(docs, parts):
            joined = np.concatenate(parts)
            lanes = max(1, min(LANES, len(joined) // 64))
            coded, marks = encode(joined, own, lanes)
            row = {"shard": shard, "block": state["block"], "start": state["start"], "n_ids": len(joined), "doc_ids": docs,
                   "doc_lengths": [len(p) for p in parts], "lanes": lanes, "coded": coded,
                   "marks": [{"step": s, "at": a, "states": x} for s, a, x in marks],
                   "ids_crc32": crc32(joined.astype("<u4").tobytes()), "coded_crc32": crc32(coded)}
            state["block"] += 1
            state["start"] += len(joined)
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        own = Table(symbols, freq) if symbols is not None else None
        docs, parts, held = [], [], 0
        for batch in batches:
            for doc, x in zip(batch.column("doc_id").to_pylist(), _unpacked(batch), strict=True):
                if held and held + len(x) > BLOCK_IDS:
                    yield block(docs, parts)
                    docs, parts, held = [], [], 0
                docs.append(doc)
                parts.append(x)
                held += len(x)
        if held:
            yield block(docs, parts)

    shards = max(1, sum(n for _, n in counts) // SHARD_IDS)
    dealt = ids.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "ids")
    dealt.select("doc_id", "width", "ids").mapInArrow(code, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks")
    blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).write.parquet(f"{path}/shards")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, the ids of each document.

    Every block is decoded on its own and must match both of its checksums, or the job fails."""
    rows = spark.read.parquet(f"{path}/table").orderBy("symbol").collect()
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["doc_ids"].dataType.elementType
    symbols, freq = np.array([r["symbol"] for r in rows], np.uint32), np.array([r["freq"] for r in rows], np.int64)
    schema = T.StructType([T.StructField("doc_id", id_type)] + T.StructType.fromDDL(
        "shard int, at long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")).fields)

    def read(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        own = Table(symbols, freq)
        for batch in batches:
            for b in range(batch.num_rows):
                row = {c: batch.column(c)[b].as_py() for c in batch.schema.names}
                marks = [(m["step"], m["at"], m["states"]) for m in row["marks"]]
                if crc32(row["coded"]) != row["coded_crc32"]:
                    raise ValueError(f"shard {row['shard']}, block {row['block']}: the coded words are damaged")
                ids = decode(row["coded"], marks, row["n_ids"], own, row["lanes"]).astype("<u4")
                if crc32(ids.tobytes()) != row["ids_crc32"]:
                    raise ValueError(f"shard {row['shard']}, block {row['block']}: the ids differ from those written")
                n = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(n)
                parts = [ids[e - k:e] for e, k in zip(ends, n, strict=True)]
                columns = [row["doc_ids"], [row["shard"]] * len(n), row["start"] + ends - n, n, [crc32(p.tobytes()) for p in parts]]
                if with_ids:
                    columns.append([p.astype(np.int64) for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    shards = spark.read.parquet(f"{path}/shards")
    starts = shards.select(F.col("shard").alias("s"), (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("before"))
    docs = blocks.mapInArrow(read, schema).join(starts, F.col("shard") == F.col("s"))
    return docs.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_files(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                vocabulary: str = bpe.VOCABULARY, path: str | None = None) -> DataFrame:
    """Write the files, to a new folder below the shared one if `path` is not given, and read them back."""
    path = path or scratch_path(df.sparkSession, "token-files")
    write_token_files(df, path, id_col, text_col, end_id, vocabulary)
    return read_token_files(df.sparkSession, path)
