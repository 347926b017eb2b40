"""Near-duplicate classes by SimHash, found with hierarchical indexes in Gray order.

An index holds distinct fingerprints sorted by their rank in Gray code, where neighbours differ in few bits. LEAF of them form a leaf
and LEAF nodes a node above. A node stores the bits that all below it share, as mask and pattern, without those that a node above
has stored already. A search carries the differences found so far down the tree, and drops a whole group once they exceed the limit.

One index over all fingerprints would have to be searched by every task, so they are routed first, exactly: when 64 bits are cut into
three, two fingerprints with at most two differing bits agree in one of the cuts. Fingerprints that agree in more than LARGE ways
are cut again in the bits that are left, as often as needed; as they are distinct, no group stays large for long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import map_texts, prepare
from hazegrid.llm.jaccard_join import components
from hazegrid.session import cut_lineage

SHINGLE = 3
DIFFERENCES = 2
SEED = 42
LEAF = 16
# Fingerprints that share a cut's bits beyond which they are cut again.
LARGE = 1_000
# Searches that go down a tree together.
SEARCHES = 2_000

U = np.uint64
_LANES = U(0x0101010101010101)


# ---- fingerprints


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set. Eight bits are counted at once, in the bytes of a word; a byte holds up to 255."""
    pad = -len(h) % 255
    rows = np.concatenate([h, np.zeros(pad, U)]).reshape(-1, 255)
    out = np.zeros(64, np.int64)
    for j in range(8):
        lanes = ((rows >> U(j)) & _LANES).sum(axis=1, dtype=U)
        out[j::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """A bit is set if over half of the shingles' hashes have it. Shingles count as often as they occur."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - k + 1
    view = memoryview(line)
    h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1:].tolist(), strict=True)), U, n)
    set_bits = np.flatnonzero(2 * bit_counts(h) > n)
    return int((U(1) << set_bits.astype(U)).sum(dtype=U)) if len(set_bits) else 0


# ---- the index


def gray_rank(f: np.ndarray) -> np.ndarray:
    """The place of each value in the sequence of Gray codes."""
    r = f.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        r ^= r >> U(shift)
    return r


class GrayIndex:
    """Distinct fingerprints in Gray order. `levels[0]` are the fingerprints, the last level has at most LEAF nodes; of each,
    `mask` marks the bits that it stores and `pattern` their values."""

    def __init__(self, fingerprints: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        self.order = np.argsort(gray_rank(fingerprints), kind="stable")
        f = fingerprints[self.order]
        levels = [(np.full(len(f), ~U(0)), f)]
        while len(levels[-1][0]) > leaf:
            mask, pattern = levels[-1]
            at = np.arange(0, len(mask), leaf)
            # shared by all below: marked in all of them, and with one value
            same = np.bitwise_and.reduceat(mask, at) & ~(np.bitwise_or.reduceat(pattern, at) ^ np.bitwise_and.reduceat(pattern, at))
            levels.append((same, pattern[at] & same))
        self.levels = []
        for i, (mask, pattern) in enumerate(levels):
            if i + 1 < len(levels):
                mask = mask & ~np.repeat(levels[i + 1][0], leaf)[:len(mask)]
            self.levels.append((mask, pattern & mask))

    def within(self, queries: np.ndarray, most: int = DIFFERENCES):
        """Pairs (query, place in `fingerprints`) with at most `most` differing bits, some thousand queries at a time."""
        for begun in range(0, len(queries), SEARCHES):
            part = queries[begun:begun + SEARCHES]
            top = len(self.levels[-1][0])
            q, node = np.repeat(np.arange(len(part)), top), np.tile(np.arange(top), len(part))
            apart = np.zeros(len(q), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                mask, pattern = self.levels[depth]
                apart = apart + np.bitwise_count((part[q] ^ pattern[node]) & mask[node])
                keep = apart <= most
                q, node, apart = q[keep], node[keep], apart[keep]
                if depth:
                    below = len(self.levels[depth - 1][0])
                    q, apart = np.repeat(q, self.leaf), np.repeat(apart, self.leaf)
                    node = (node[:, None] * self.leaf + np.arange(self.leaf)).ravel()
                    keep = node < below
                    q, node, apart = q[keep], node[keep], apart[keep]
            yield q + begun, self.order[node]


def linked(fingerprints: np.ndarray, most: int = DIFFERENCES) -> np.ndarray:
    """For each fingerprint the place of the first that links reach from it within this group."""
    m = len(fingerprints)
    root = np.arange(m)
    for a, b in GrayIndex(fingerprints).within(fingerprints, most):
        a, b = a[a < b], b[a < b]
        while True:
            x, y = root[a], root[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            open_ = low < high
            if not open_.any():
                break
            np.minimum.at(root, high[open_], low[open_])
            while (root != root[root]).any():
                root = root[root]
    return root


# ---- routing


def cut(open_bits: list[int], parts: int) -> list[list[int]]:
    """`parts` runs of the bits that are not fixed yet, of nearly equal length."""
    return [x.tolist() for x in np.array_split(np.array(open_bits, np.int64), parts)]


def _signed(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _edges(batches):
    """Links of each group (mask, value) of the sorted rows, as pairs of a fingerprint and the first one it is connected to. A group is
    at most LARGE long; what a batch leaves open waits for the next."""
    held: list[pa.RecordBatch] = []

    def pairs(mask, value, fp):
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
        a, b = [], []
        for i, j in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(fp)].tolist(), strict=True):
            root = linked(fp[i:j].view(U))
            far = np.flatnonzero(root != np.arange(j - i))
            a.append(fp[i:j][far])
            b.append(fp[i:j][root[far]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def columns(table):
        return [table.column(c).to_numpy() for c in ("mask", "value", "fp")]

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        mask, value, _ = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "value", "fp"))
        last = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
        if len(last):
            # all groups but the batch's last one are whole now
            end = int(last[-1]) + 1
            table = pa.Table.from_batches([*held[:-1], batch.slice(0, end)])
            yield pairs(*columns(table))
            held = [batch.slice(end)]
    if held:
        yield pairs(*columns(pa.Table.from_batches(held)))


def _links(nodes: DataFrame, most: int, large: int) -> DataFrame:
    """Edges (a, b) that connect the fingerprints `fp` of `nodes` as all their links do. Groups of a cut are counted first: those of one
    fingerprint are done, those beyond `large` are cut again."""
    found = None
    at, states = nodes.select("fp", F.lit(0).cast("long").alias("mask")), {0: list(range(64))}
    while True:
        # each state (bits fixed so far) goes on in most + 1 ways
        ways, following = {}, {}
        for mask, open_bits in states.items():
            fixed = [b for b in range(64) if b not in set(open_bits)]
            for piece in cut(open_bits, most + 1):
                new = _signed(fixed + piece)
                following[new] = [b for b in open_bits if b not in set(piece)]
                ways.setdefault(mask, []).append(new)
        options = F.lit(None).cast("array<long>")
        for mask, masks in ways.items():
            options = F.when(F.col("mask") == mask, F.array(*[F.lit(m) for m in masks])).otherwise(options)
        keyed = at.select("fp", F.explode(options).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
        sized = cut_lineage(keyed.join(sizes, ["mask", "value"]), "cuts")
        groups = sized.where((F.col("n") <= large) if min(map(len, following.values())) > most else F.lit(True)).select("mask", "value", "fp")
        edges = groups.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(_edges, "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        left = sized.where(F.col("n") > large)
        masks = [r["mask"] for r in left.select("mask").distinct().collect()]
        if not masks or min(map(len, following.values())) <= most:
            return found
        # the same fingerprint may come on several ways to one mask
        at, states = cut_lineage(left.select("fp", "mask").distinct(), "left"), {m: following[m] for m in masks}


def simhash_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = DIFFERENCES, k: int = SHINGLE,
                    large: int = LARGE) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest id that links reach, its own included) for each row. Two rows link when
    their fingerprints differ in at most `most` bits.

    Rows with one fingerprint are one node from the start, combined before the shuffle. Each node goes to `most` + 1 groups by the bits of a cut, and
    the groups' indexes find its links; only edges to the first fingerprint of a connected group leave a task. Nothing is capped or
    approximated. Runs jobs; intermediate tables go to the shared folder.

    Null and empty texts and texts without words have fingerprint zero and are linked like any other. Texts shorter than `k` words are
    one shingle. Whole texts are hashed, however long. A null id is no smallest id, unless all of a component are null. Repeated rows have one component. An empty
    table gives an empty result; other columns are ignored."""
    prepare(df.sparkSession)

    def make():
        def prints(texts):
            return [np.array([fingerprint(t, k) for t in texts], U).view(np.int64).tolist()]
        return prints

    docs = cut_lineage(map_texts(df, {id_col: "doc_id"}, text_col, "fp long", make), "fingerprints")
    nodes = cut_lineage(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(_links(nodes, most, large)).withColumnRenamed("node", "fp")
    labelled = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    per_print = labelled.join(least, "root").select("fp", "component_id")
    return docs.join(per_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
