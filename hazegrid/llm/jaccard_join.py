"""Near-duplicate classes by Jaccard similarity of word n-grams, found with R-trees over count vectors.

Each document's shingles are hashed to GROUPS groups; the counts per group are a point. Two sets share at most the sum
over groups of the smaller count, so two nodes of an R-tree can hold a link only if the summed minima of their upper corners
reach 3/7 of their least sizes. Surviving pairs are verified on the sets themselves.

In so many dimensions one tree over all documents would prune little, so documents are first routed to clusters, exactly: linked sets
share one of their rarest shingles (all but the last ceil(0.75 n) - 1 in order of rarity). Each cluster gets a tree of its own.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm.common import BROADCAST_ROWS, slices
from hazegrid.session import cut_lineage, scratch_path

SHINGLE = 5
GROUPS = 32
LEAF = 16
# Two sets link when 100 |A and B| >= PERCENT |A or B|.
PERCENT = 75
# Documents of a cluster that meet in one tree; larger clusters are cut into tiles.
TILE_ROWS, TILE_SHINGLES = 1_500, 2_000_000
# Bit rows of a tile, and of one step of comparisons.
BIT_BYTES, STEP_BYTES = 64 << 20, 8 << 20
CHUNK_POSTINGS, BUCKET_POSTINGS = 1_000_000, 1_000_000

U = np.uint64
_MIX = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: str, k: int = SHINGLE) -> np.ndarray:
    """The set's 64-bit hashes, ascending. A-Z are lower-cased; words are cut at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], U)
    a = np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words))
    n = len(a) - k + 1
    h = np.zeros(n, U)
    for j in range(k):
        h = (h ^ a[j:j + n]) * _MIX[j % len(_MIX)]
        h ^= h >> U(29)
    return np.unique(h)


def least_shared(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n with any set it links to."""
    return -(-n * percent // 100)


def _front(n: int) -> int:
    """How many of a set's smallest hashes are compared in the first, coarse pass."""
    return n if n <= 32 else -(-2 * n // 5)


@lru_cache(maxsize=65536)
def _front_shared(n: int, percent: int = PERCENT) -> int:
    """How many of them every linked set has among its own: both fronts hold the first of the common hashes."""
    sizes = range(least_shared(n, percent), n * 100 // percent + 1)
    if len(sizes) > 400:
        # beyond 32 the bound grows with the size, but for rounding
        sizes = range(sizes[0], sizes[0] + 200)
    return max(1, min(_front(m) - (m - least_shared(m, percent)) for m in sizes))


# ---- the coarse pass: which sets share enough of their front with any others


def _fronts(bits: int, schema: T.StructType, k: int, percent: int):
    """Document rows (doc_id, mark, n, key; number, hashes shared and hashes needed of the chunk's distinct sets), and per chunk and bucket the front hashes."""
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        task, chunk = TaskContext.get().partitionId(), 0
        docs, numbers, fronts, held = [], {}, [], 0

        def flush():
            nonlocal docs, numbers, fronts, held, chunk
            base = (task << 36 | chunk << 24)
            sizes = np.array([len(f) for f in fronts], np.int64)
            h = np.concatenate(fronts) if fronts else np.zeros(0, U)
            owner = np.repeat(np.arange(len(fronts)), sizes)
            once, at, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            # hashes that several sets of the chunk have are known to be shared, and sent once
            local = np.bincount(owner, weights=(count > 1)[inverse], minlength=len(fronts)).astype(np.int64)
            sender = np.where(count > 1, -1, base + owner[at])
            yield pa.RecordBatch.from_pylist([{"doc_id": d, "mark": mark, "n": n, "key": key, "number": None if i is None else base + i,
                                               "shared": None if i is None else int(local[i]), "needed": _front_shared(n, percent) if n else None} for d, mark, n, key, i in docs], schema=arrow)
            bucket = (once >> U(64 - bits)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            rest = (once << U(bits) >> U(32)).astype("<u4")
            rows = [{"bucket": b, "hashes": rest[x:y].tobytes(), "senders": sender[x:y].astype("<i8").tobytes()}
                    for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if y > x]
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[i:i + 64], schema=arrow)
            docs, numbers, fronts, held, chunk = [], {}, [], 0, chunk + 1

        for batch in batches:
            for part in slices(batch, "text"):
                for d, mark, t in zip(*(part.column(c).to_pylist() for c in ("doc_id", "mark", "text")), strict=True):
                    s = shingles(t, k)
                    key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                    first = None
                    if key is not None and key not in numbers:
                        first = numbers[key] = len(fronts)
                        fronts.append(s[:_front(len(s))])
                        held += len(fronts[-1])
                    docs.append((d, mark, len(s), key, first))
                    if held >= CHUNK_POSTINGS or len(docs) >= 1 << 20:
                        yield from flush()
        if docs:
            yield from flush()
    return run


def _shared(bucket: pa.Table) -> pa.Table:
    """How many of its hashes in this bucket each sender shares with other chunks."""
    h = np.concatenate([np.frombuffer(x, "<u4") for x in bucket.column("hashes").to_pylist()])
    sender = np.concatenate([np.frombuffer(x, "<i8") for x in bucket.column("senders").to_pylist()])
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    number, n = np.unique(sender[(count > 1)[inverse] & (sender >= 0)], return_counts=True)
    return pa.table({"number": pa.array(number, pa.int64()), "more": pa.array(n, pa.int64())})


# ---- connected components of links


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for edges (a, b). Each round takes the least label among neighbours and
    then that label's label; labels are written each round, and rounds end when none changes."""
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        of_b = labels.select(F.col("node").alias("nb"), F.col("root").alias("rb"))
        least = both.join(of_b, F.col("b") == F.col("nb")).groupBy("a").agg(F.min("rb").alias("near"))
        step = labels.join(least, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        step = cut_lineage(step, "labels")
        up = step.select(F.col("node").alias("p"), F.col("root").alias("top"))
        jumped = cut_lineage(step.join(up, F.col("root") == F.col("p")).select("node", "old", F.least("root", "top").alias("root")), "labels")
        labels = jumped.select("node", "root")
        if jumped.where("root <> old").isEmpty():
            return labels


# ---- the R-tree join


class RTree:
    """Points bulk-loaded by size and then by their coordinates of largest spread, LEAF to a node; each node keeps its
    upper corner and its least size. `order` gives the point at each place of the lowest level."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        m = len(sizes)
        spread = np.argsort(-points.var(axis=0))[:2]
        slab = np.empty(m, np.int64)
        slab[np.argsort(sizes, kind="stable")] = np.arange(m) // (LEAF * 8)
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]], slab))
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > 1:
            upper, least = self.levels[-1]
            at = np.arange(0, len(least), LEAF)
            self.levels.append((np.maximum.reduceat(upper, at), np.minimum.reduceat(least, at)))

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of points whose bound allows a link, descending from the root pair by pair."""
        a = b = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least = self.levels[depth]
            if depth < len(self.levels) - 1:
                kids = np.arange(LEAF)
                a, b = (np.repeat(a, LEAF * LEAF) * LEAF + np.tile(np.repeat(kids, LEAF), len(a)),
                        np.repeat(b, LEAF * LEAF) * LEAF + np.tile(kids, len(b) * LEAF))
                keep = (a < len(least)) & (b < len(least)) & ((a < b) if depth == 0 else (a <= b))
                a, b = a[keep], b[keep]
            elif depth == 0:
                return a[:0], b[:0]
            parts = []
            for i in range(0, len(a), 100_000):
                x, y = a[i:i + 100_000], b[i:i + 100_000]
                most = np.minimum(upper[x], upper[y]).sum(axis=1, dtype=np.int64)
                room = (100 + percent) * most - percent * (least[x] + least[y])
                parts.append(np.flatnonzero(room >= 0) + i)
            at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            a, b = a[at], b[at]
        return self.order[a], self.order[b]


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """|A and B| for each pair of sets: from bit rows over the hashes that several of the sets have, or, where the rows would be
    much longer than the sets, from the sets themselves."""
    if not len(a):
        return np.zeros(0, np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[inverse]
    width = -(-int((count > 1).sum()) // 64) * 8
    if width * len(sets) > BIT_BYTES or width > 64 * sizes.mean():
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    rows = np.zeros((len(sets), width), np.uint8)
    for i, at in enumerate(np.split(place, np.cumsum(sizes)[:-1])):
        flags = np.zeros(width * 8, bool)
        flags[at[at >= 0]] = True
        rows[i] = np.packbits(flags)
    rows = rows.view(U)
    step = max(1, STEP_BYTES // max(width, 1))
    return np.concatenate([np.bitwise_count(rows[a[i:i + step]] & rows[b[i:i + step]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), step)])


def links(sets: list[np.ndarray], percent: int = PERCENT, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of linked sets, as two arrays of places. With `side`, only pairs of different sides."""
    sizes = np.array([len(s) for s in sets], np.int64)
    points = np.stack([np.bincount((s >> U(59)).astype(np.int64), minlength=GROUPS) for s in sets]).astype(np.int32)
    a, b = RTree(points, sizes).pairs(percent)
    if side is not None:
        cross = side[a] != side[b]
        a, b = a[cross], b[cross]
    both = overlaps(sets, a, b)
    true = 100 * both >= percent * (sizes[a] + sizes[b] - both)
    return a[true], b[true]


def classes(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that pairs (a, b) connect each of m places with."""
    label = np.arange(m)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _sets(group: pa.Table) -> list[np.ndarray]:
    return [np.sort(np.asarray(s.values.to_numpy(zero_copy_only=False)).view(U)) for s in group.column("hashes")]


def _links_of(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many rows each place's linked sets stand for."""
    n = np.zeros(len(rows), np.int64)
    np.add.at(n, a, rows[b])
    np.add.at(n, b, rows[a])
    return n


def _within(percent: int):
    """The class of each set by the links inside a tile, and how many rows it links to there."""
    def run(group: pa.Table) -> pa.Table:
        u, rows = group.column("u").to_numpy(), group.column("rows").to_numpy()
        a, b = links(_sets(group), percent)
        return pa.table({"u": u, "label": u[classes(len(u), a, b)], "links": _links_of(rows, a, b)})
    return run


def _across(percent: int):
    """The same for links between two tiles; sets without any are left out."""
    def run(group: pa.Table) -> pa.Table:
        u, rows = group.column("u").to_numpy(), group.column("rows").to_numpy()
        a, b = links(_sets(group), percent, side=group.column("tile").to_numpy())
        n = _links_of(rows, a, b)
        return pa.table({"u": u[n > 0], "label": u[classes(len(u), a, b)][n > 0], "links": n[n > 0]})
    return run


# ---- the join


def _candidate_sets(docs: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, n, key), and the sets (u, key, n, hashes) that the coarse pass could not rule out; a set may come from several tasks."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word has about six bytes, two in five shingles are sent
    bits = max(6, min(24, int(np.ceil(np.log2(1 + total / 15 / BUCKET_POSTINGS)))))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"doc_id {id_type}, mark long, n long, key binary, number long, shared long, needed int, bucket int, hashes binary, senders binary")
    # a document is known again by its id and a hash of its text, so many rows under one id stay apart
    docs = docs.withColumn("mark", F.xxhash64("text"))
    path = scratch_path(spark, "fronts")
    docs.mapInArrow(_fronts(bits, schema, k, percent), schema).write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    every = stored.where("bucket is null").select("doc_id", "mark", "n", "key", "number", "shared", "needed")
    more = stored.where("bucket is not null").select("bucket", "hashes", "senders").groupBy("bucket").applyInArrow(_shared, "number long, more long")
    more = more.groupBy("number").agg(F.sum("more").alias("more")).withColumnRenamed("number", "m")

    hopeful = (every.where("number is not null").join(more, F.col("number") == F.col("m"), "left")
               .where(F.col("shared") + F.coalesce("more", F.lit(0)) >= F.col("needed")))
    reps = cut_lineage(hopeful.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "mark")).alias("r"))
                       .select(F.col("key").alias("rep_key"), F.col("r.id").alias("rep"), F.col("r.mark").alias("rep_mark")), "reps")
    few = reps.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(reps) if few else reps, (F.col("mark") == F.col("rep_mark")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("rep_key", "text")

    def build(batches):
        seen: set = set()
        for batch in batches:
            for part in slices(batch, "text"):
                keys = part.column("rep_key").to_pylist()
                found = [shingles(t, k) for t in part.column("text").to_pylist()]
                own = [i for i, (key, s) in enumerate(zip(keys, found, strict=True)) if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == key
                       and key not in seen and not seen.add(key)]
                if len(seen) > 1 << 17:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in own], pa.binary()), pa.array([len(found[i]) for i in own], pa.int64()),
                                                  pa.array([found[i].view(np.int64) for i in own], pa.list_(pa.int64()))], names=["key", "n", "hashes"])

    sets = texts.mapInArrow(build, "key binary, n long, hashes array<long>")
    return every.select("doc_id", "n", "key"), cut_lineage(sets.select(F.monotonically_increasing_id().alias("u"), "key", "n", "hashes"), "sets")


def _clusters(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """v, cluster for the sets that share one of their rarest shingles with another set, and the rarest shingles (u, h)."""
    rows = sets.select("u", "n", F.explode("hashes").alias("h"))
    common = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").withColumnRenamed("h", "g")
    mine = Window.partitionBy("u")
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.count("*").over(mine))
    rare = (rows.join(common, F.col("h") == F.col("g")).withColumn("spare", spare)
            .withColumn("place", F.row_number().over(mine.orderBy("df", "h"))).where("place <= spare").select("u", "h"))
    rare = cut_lineage(rare, "rare")
    leaders = rare.groupBy("h").agg(F.min("u").alias("leader"), F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("g"), "leader")
    stars = rare.join(leaders, F.col("h") == F.col("g")).where("u <> leader").select(F.col("u").alias("a"), F.col("leader").alias("b")).distinct()
    return components(stars).select(F.col("node").alias("v"), F.col("root").alias("cluster")), rare


def _tiles(routed: DataFrame, rare: DataFrame, tile_rows: int, tile_shingles: int) -> DataFrame:
    """`routed` with a tile. Sets of a cluster whose least rare shingle is the same stay together; those of one that has
    more than a quarter of a tile are cut by their numbers, the others of a cluster share tiles."""
    lead = rare.groupBy("u").agg(F.min("h").alias("lead")).withColumnRenamed("u", "x")
    led = cut_lineage(routed.select("u", "cluster", "n").join(lead, F.col("u") == F.col("x")).select("u", "cluster", "n", "lead"), "led")
    share = F.greatest(F.col("sets") / tile_rows, F.col("shingles") / tile_shingles)
    units = led.groupBy("cluster", "lead").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).withColumn("share", share)
    units = cut_lineage(units.select("cluster", "lead", "share"), "units")
    spread = units.where("share <= 0.25").groupBy("cluster").agg(F.ceil(F.sum("share")).alias("common")).withColumnRenamed("cluster", "cc")
    of_unit = units.join(spread, F.col("cluster") == F.col("cc"), "left").select(
        F.col("cluster").alias("uc"), F.col("lead").alias("ul"), "share", "common")
    placed = led.join(of_unit, (F.col("cluster") == F.col("uc")) & (F.col("lead") == F.col("ul"))).select(
        F.col("u").alias("p"), F.when(F.col("share") <= 0.25, F.pmod(F.xxhash64("lead"), F.col("common")))
        .otherwise(F.xxhash64("lead", F.pmod(F.xxhash64("u"), F.ceil("share")))).alias("tile"))
    return routed.join(placed, F.col("u") == F.col("p")).drop("p")


def _linked_classes(sets: DataFrame, rows: DataFrame, percent: int, tile_rows: int, tile_shingles: int) -> DataFrame:
    """u, label, links: sets of one label are connected by links; links counts the rows of the sets that a set links to. Sets that
    share no rare shingle with another are missing. `rows` (r, rows) holds the sets to take and the rows each stands for."""
    spark = sets.sparkSession
    clusters, rare = _clusters(sets, percent)
    routed = (sets.join(clusters, F.col("u") == F.col("v")).join(rows, F.col("u") == F.col("r"))
              .select("cluster", "u", "n", "rows", "hashes"))
    routed = cut_lineage(routed, "routed")
    tiled = cut_lineage(_tiles(routed, rare, tile_rows, tile_shingles).select("cluster", "tile", "u", "rows", "hashes"), "tiled")
    result = "u long, label long, links long"
    inside = cut_lineage(tiled.groupBy("cluster", "tile").applyInArrow(_within(percent), result), "inside")
    # Tiles meet only where they have a rare shingle in common, as linked sets do.
    places = tiled.select("cluster", "tile", "u")
    spans = places.groupBy("cluster").agg(F.min("tile").alias("low"), F.max("tile").alias("high")).where("low < high").select(F.col("cluster").alias("wide"))
    held = (rare.withColumnRenamed("u", "x").join(places.join(spans, F.col("cluster") == F.col("wide")), F.col("x") == F.col("u"))
            .select("cluster", "h", "tile").distinct())
    held = cut_lineage(held, "held")
    if held.isEmpty():
        return inside
    other = held.select(F.col("cluster").alias("oc"), F.col("h").alias("oh"), F.col("tile").alias("j"))
    meet = held.join(other, (F.col("h") == F.col("oh")) & (F.col("cluster") == F.col("oc")) & (F.col("tile") < F.col("j"))).select(
        F.col("cluster").alias("mc"), F.col("tile").alias("i"), "j").distinct()
    sides = cut_lineage(meet, "meet").select("mc", "i", "j", F.explode(F.array("i", "j")).alias("t"))
    met = tiled.join(sides, (F.col("cluster") == F.col("mc")) & (F.col("tile") == F.col("t"))).select("cluster", "i", "j", "tile", "u", "rows", "hashes")
    across = cut_lineage(met.groupBy("cluster", "i", "j").applyInArrow(_across(percent), result), "across")
    every = inside.unionByName(across)
    counts = every.groupBy("u").agg(F.sum("links").alias("links"))
    joined = components(every.where("u <> label").select(F.col("u").alias("a"), F.col("label").alias("b")))
    return counts.join(joined, F.col("u") == F.col("node"), "left").select("u", F.coalesce("root", "u").alias("label"), "links")


def ngram_jaccard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = SHINGLE,
                  tile_rows: int = TILE_ROWS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row: the smallest id that links reach, its own included, and the number of other
    rows it links to itself, equal ones counted.

    Equal sets are one set from the start. Nothing is capped, sampled or approximated but the 64-bit hashes of shingles. Runs jobs;
    intermediate tables go to the shared folder:
    1. Texts are cut into shingles, and the smallest hashes of each set are compared. Sets that share too few with any other
       are done. Within a chunk of a task a hash is sent once, however many sets have it.
    2. Of the others, each set's rarest shingles route it to a cluster (connected components of shared rare shingles).
    3. A cluster's sets, or a tile of them, meet in one task, in an R-tree of count vectors; two tiles of a large cluster meet
       if they have a rare shingle in common. Every pair that the tree leaves is verified, so the work in a group of near copies
       grows with the square of its distinct texts; equal ones count as one.

    Null and empty texts have no shingles and are linked with nothing, so component_id is their own id and n_links 0. A null id is no
    smallest id, unless all of a component are null. Repeated rows have one component. A very long text is one set and is never cut. An empty table gives an empty result; other columns are ignored."""
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    every, sets = _candidate_sets(docs, percent, k)
    # one row per set: its smallest id and its rows, then the smallest id of its class
    per_set = every.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    own = sets.groupBy(F.col("key").alias("own_key")).agg(F.min("u").alias("r"))
    own = cut_lineage(own.join(per_set, F.col("own_key") == F.col("key")).select("own_key", "r", "rows"), "rows")
    labels = _linked_classes(sets, own.select("r", "rows"), percent, tile_rows, tile_shingles)
    named = labels.join(own, F.col("u") == F.col("r")).select("own_key", "label", "links")
    per_set = per_set.join(named, F.col("key") == F.col("own_key"), "left")
    per_label = per_set.where("label is not null").groupBy("label").agg(F.min("least").alias("class_least")).withColumnRenamed("label", "l")
    found = per_set.join(per_label, F.col("label") == F.col("l"), "left").select(
        F.col("key").alias("set_key"), F.coalesce("class_least", "least").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    return every.join(found, F.col("key") == F.col("set_key"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) as i from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as n from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from i join n x on x.doc_id = i.a join n y on y.doc_id = i.b where 100 * i.n >= 75 * (x.n + y.n - i.n)),
both_ways as (select a, b from e union all select b, a from e),
r as (select doc_id, doc_id as c from d union select both_ways.b, r.c from r join both_ways on both_ways.a = r.doc_id),
l as (select a as doc_id, count(*) as n_links from both_ways group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.c) as component_id, coalesce(l.n_links, 0) as n_links
from d join r using (doc_id) left join n using (doc_id) left join l using (doc_id) group by d.doc_id, n.n, l.n_links
"""
