"""Product codes of vectors: a codebook per part of the vector, entries found by Orchard's search.

Every entry keeps the list of the others by rising distance. A search stands at one entry and walks its list; when it
meets a nearer entry it jumps to that entry's list. It ends where the list goes beyond twice the current distance, for by the triangle
inequality nothing behind can be nearer. Entries already met are marked and not compared again.

All arithmetic is on whole numbers, so codebooks and codes are the same however the rows are dealt out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import BROADCAST_ROWS, prepare
from hazegrid.operators.lookup import join_on
from hazegrid.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Of a list, so many entries are compared at a time.
STRIDE = 16
# Rows searched together; each has a mark per entry.
ROWS = 4096
# Whole-number components beyond this could overflow the sums of squares.
LARGEST = 1 << 27


class Codebook:
    """Entries of one part, with each entry's list of all entries by distance (ties to the lower index)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.apart = np.stack([((entries - e) ** 2).sum(axis=1) for e in entries])
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        self.along = np.take_along_axis(self.apart, self.order, axis=1)
        # a search begins at the entry whose components add up to about as much
        sums = entries.sum(axis=1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def _distance(self, vectors: np.ndarray, entry: np.ndarray) -> np.ndarray:
        d = vectors - self.entries[entry]
        return np.einsum("ij,ij->i", d, d)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry (ties to the lower index), and how many comparisons that took."""
        m = len(self.entries)
        best = self.by_sum[np.minimum(np.searchsorted(self.sums, vectors.sum(axis=1)), m - 1)]
        dist = self._distance(vectors, best)
        met = np.zeros((len(vectors), m), bool)
        met[np.arange(len(vectors)), best] = True
        place = np.zeros(len(vectors), np.int64)
        walking, compared = np.arange(len(vectors)), len(vectors)
        while len(walking):
            at, here = np.minimum(place[walking, None] + np.arange(STRIDE), m - 1), best[walking, None]
            entry, near = self.order[here, at], self.along[here, at] <= 4 * dist[walking, None]
            row, col = np.nonzero(near & ~met[walking[:, None], entry])
            if len(row):
                of, e = walking[row], entry[row, col]
                met[of, e] = True
                d = self._distance(vectors[of], e)
                compared += len(d)
                # the least (distance, index) of each row comes first
                first = np.lexsort((e, d, row))
                first = first[np.r_[True, row[first][1:] != row[first][:-1]]]
                of, e, d = of[first], e[first], d[first]
                better = (d < dist[of]) | ((d == dist[of]) & (e < best[of]))
                jumped = of[better]
                best[jumped], dist[jumped] = e[better], d[better]
            else:
                jumped = np.zeros(0, np.int64)
            place[walking] += STRIDE
            place[jumped] = 0
            stays = near[:, -1] & (place[walking] < m)
            stays[np.isin(walking, jumped)] = True
            walking = walking[stays]
        return best, dist, compared


def _whole(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers from a column of lists."""
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    if len(flat) != len(vectors) * width:
        raise ValueError(f"all vectors must have {width} components")
    whole = np.floor(flat * SCALE)
    if len(whole) and np.abs(whole).max() >= LARGEST:
        raise ValueError(f"a component of {SCALE} * {np.abs(flat).max()} is beyond {LARGEST}")
    return whole.astype(np.int64).reshape(len(vectors), width)


def _pieces(batches, column: str, width: int):
    """Slices of at most ROWS rows with their whole numbers."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part, _whole(part.column(column), width)


def _gather(books: list[np.ndarray], width: int):
    """One pass of a task: per part, entry and position the sum, and per entry (position -1) the number of its vectors."""
    def run(batches):
        search = [Codebook(b) for b in books]
        w = width // len(books)
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for _, x in _pieces(batches, "vector", width):
            for p, book in enumerate(search):
                own = x[:, p * w:(p + 1) * w]
                entry = book.nearest(own)[0]
                np.add.at(sums[p], entry, own)
                counts[p] += np.bincount(entry, minlength=len(counts[p]))
        for p, (s, c) in enumerate(zip(sums, counts, strict=True)):
            used = np.flatnonzero(c)
            entry = np.r_[np.repeat(used, w), used]
            position = np.r_[np.tile(np.arange(w), len(used)), np.full(len(used), -1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p), pa.int32()), pa.array(entry, pa.int32()), pa.array(position, pa.int32()),
                                              pa.array(np.r_[s[used].ravel(), c[used]])], names=["part", "entry", "position", "total"])
    return run


def _encode(books: list[np.ndarray], width: int):
    def run(batches):
        search = [Codebook(b) for b in books]
        w = width // len(books)
        for part, x in _pieces(batches, "vector", width):
            found = [book.nearest(x[:, p * w:(p + 1) * w])[:2] for p, book in enumerate(search)]
            codes = np.stack([e for e, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            step = 2 * len(books)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("label"), pa.array([codes[i:i + step] for i in range(0, len(codes), step)], pa.string()),
                 pa.array(sum(d for _, d in found))], names=["vec_id", "label", "code", "error"])
    return run


def finite(vector: Column) -> Column:
    """True if the vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, **more: str) -> DataFrame:
    """vec_id, vector (doubles) and `more` (new name = column) of the rows whose vector is finite throughout."""
    v = F.col(f"`{vector_col}`")
    return df.where(finite(v)).select(F.col(f"`{id_col}`").alias("vec_id"), v.cast("array<double>").alias("vector"),
                                      *[F.col(f"`{c}`").alias(n) for n, c in more.items()])


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Whole-number codebooks of `rows` (vec_id, vector). Runs one job per round, and one for the first entries. The sums of a
    round are added up by Spark; a codebook's own size reaches the driver, however many rows there are."""
    # nulls last, so that a row without an id starts no entry while others do
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toPandas()["vector"].tolist()
    if not first:
        return []
    width = len(first[0])
    if width % parts or width == 0:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    start = _whole(pa.array(first, pa.list_(pa.float64())), width)
    books = [b.copy() for b in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        sums = rows.select("vector").mapInArrow(_gather(books, width), "part int, entry int, position int, total long")
        totals = sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total")).toPandas()
        counts = {(p, e): n for p, e, at, n in totals.itertuples(index=False) if at < 0}
        for p, e, at, total in totals.itertuples(index=False):
            if at >= 0:
                books[p][e, at] = total // counts[p, e]
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each row with a finite vector.

    Each round assigns every part of every vector to its codebook's nearest entry by Orchard's search, and sums per entry are
    combined in the task before they are shuffled: a vector that a third of all rows share costs no more than any other. The codebooks
    (parts x entries x positions whole numbers) go to the tasks with the function. Runs a job per round and one that
    writes the codes to the shared folder.

    Rows whose vector is null or holds null or non-finite components are left out. Null ids rank last for the first entries, rows of one
    id by their vectors; rows with a null label are one label. Repeated rows are coded each. With fewer rows than entries there are as many entries as rows.
    An empty table gives an empty result; other columns are ignored. Vectors must have one length, a multiple of `parts`, and
    components within 2^27 / 1024, or a ValueError says so."""
    spark = df.sparkSession
    prepare(spark)
    rows = kept_vectors(df, id_col, vector_col, label=label_col)
    ids, labels = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    books = codebooks(rows, parts, entries, rounds)
    if not books:
        return spark.createDataFrame([], f"vec_id {ids}, code string, error long, label_error long, codebooks_sha256 string")
    width = sum(b.shape[1] for b in books)
    coded = cut_lineage(rows.mapInArrow(_encode(books, width), f"vec_id {ids}, label {labels}, code string, error long"), "codes")
    sums = cut_lineage(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    side = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    return join_on(coded, side, ["label"], null_safe=True).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds spelled out one after another; entry 0-based, positions 1-based."""
    assign = """a{i} as (select vec_id, part, entry, dist from (
      select t.vec_id, t.part, b.entry, list_sum(list_transform(list_zip(t.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as dist,
             row_number() over (partition by t.vec_id, t.part order by dist, b.entry) as place
      from t join b{i} b using (part)) where place = 1)"""
    update = """s{i} as (select t.part, a.entry, x.pos, sum(x.c) as total, count(*) as n
      from a{i} a join t using (vec_id, part), unnest(list_zip(t.v, range(1, len(t.v) + 1))) as u(y), (select y[1] as c, y[2] as pos) as x group by all),
    m{i} as (select part, entry, list(((total - (total % n + n) % n) // n)::bigint order by pos) as v from s{i} group by all),
    b{j} as (select b.part, b.entry, coalesce(m.v, b.v) as v from b{i} b left join m{i} m using (part, entry))"""
    rounds = ",\n    ".join(f"{assign.format(i=i)},\n    {update.format(i=i, j=i + 1)}" for i in range(ROUNDS))
    return f"""
    with k as (select vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::double)::bigint) as v from embeddings
      where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
    t as (select vec_id, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] as v from k, range(4) as r(part)),
    f as (select vec_id, row_number() over (order by vec_id) - 1 as entry from k order by vec_id limit 256),
    b0 as (select t.part, f.entry, t.v from f join t using (vec_id)),
    {rounds},
    {assign.format(i=ROUNDS)},
    c as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(dist)::bigint as error from a{ROUNDS} group by vec_id),
    h as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from b{ROUNDS})
    select k.vec_id, c.code, c.error, (sum(c.error) over (partition by k.label))::bigint as label_error, h.codebooks_sha256
    from k join c using (vec_id), h"""


ORACLE = _oracle()
