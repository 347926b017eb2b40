"""Vector codes, whitening and SimHash classes against plain versions."""

import hashlib
import math
import random
from itertools import pairwise

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from hazegrid.llm import simhash, vector_codes, whitening

CLASHING = ["x", "vector", "code", "n", "component", "error", "i", "total", "part", "entry", "position", "whitened", "fp", "mask"]
SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]
                      + [T.StructField(c, T.StringType()) for c in CLASHING])


def vectors(n: int, width: int = 8, spread: float = 0.05):
    """Rows with every awkward case: null and non-finite vectors, null ids and labels, repeated rows, one vector on a third of the rows."""
    draw = np.random.default_rng(3)
    out = []
    for i in range(n):
        v = (draw.standard_normal(width) * spread).astype(np.float32).tolist() if i % 3 else [0.25, -0.125] * (width // 2)
        out.append((i * 3 % (n + 7), v, None if i % 11 == 0 else i % 4))
    out += [(1_000, None, 1), (1_001, [None] + [0.1] * (width - 1), 1), (1_002, [math.nan] * width, 2), (1_003, [math.inf] + [0.0] * (width - 1), None),
            (1_004, [-math.inf] * width, 0), (None, [-0.0] * width, 1), (None, [0.5] * width, None)]
    return out + [(*r[:2], 9) for r in out[5:8]] + out[7:9]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *(["clash"] * len(CLASHING))) for r in rows], SCHEMA).repartition(3)


def kept(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


# ---- vector codes


def plain_codes(rows, parts, entries, rounds):
    """Every vector against every entry."""
    good = [(i, [math.floor(1024 * np.float32(c).item()) for c in v], l) for i, v, l in kept(rows)]
    if not good:
        return []
    w = len(good[0][1]) // parts
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * w:(p + 1) * w] for r in first] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * w:(p + 1) * w], e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        member = {}
        for _, v, _ in good:
            for p in range(parts):
                member.setdefault((p, nearest(p, v)[1]), []).append(v[p * w:(p + 1) * w])
        for (p, e), vs in member.items():
            books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [(i, l, [nearest(p, v) for p in range(parts)]) for i, v, l in good]
    total = {}
    for _, l, near in found:
        total[l] = total.get(l, 0) + sum(d for d, _ in near)
    return [(i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), total[l], digest) for i, l, near in found]


@pytest.mark.parametrize("n, entries", [(0, 256), (90, 256), (150, 12)])
def test_codes_equal_a_full_search(spark, rows, n, entries):
    made = vectors(n) if n else vectors(0)[5:7]
    out = vector_codes.vector_codes(frame(spark, made), entries=entries)
    assert rows(out, "vec_id", "code", "error", "label_error", "codebooks_sha256") == sorted(plain_codes(made, 4, entries, 4), key=repr)


def test_codes_of_an_empty_table(spark):
    assert vector_codes.vector_codes(frame(spark, [])).count() == 0
    assert vector_codes.vector_codes(frame(spark, [(1, None, 1)])).count() == 0


def test_codes_refuse_vectors_they_cannot_cut(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(frame(spark, [(1, [0.1] * 7, 1)]))


def test_search_compares_few_entries_and_breaks_ties_downwards():
    draw = np.random.default_rng(1)
    for m, w, reach in ((256, 2, 4000), (256, 16, 300), (5, 3, 2), (1, 4, 9), (40, 1, 3)):
        entries, q = draw.integers(-reach, reach, (m, w)), draw.integers(-reach, reach, (500, w))
        entries[m // 2] = entries[0]
        found, dist, compared = vector_codes.Codebook(entries).nearest(q)
        full = ((q[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (found == full.argmin(axis=1)).all() and (dist == full.min(axis=1)).all()
        if (m, w) == (256, 2):
            assert compared < 500 * m / 4


# ---- whitening


def plain_whitening(rows, k):
    good = [(i, [math.floor(256 * np.float32(c).item()) for c in v]) for i, v, _ in kept(rows)]
    fit = np.array(sorted({tuple(v) for _, v in good}))
    n, s, mean = len(fit), fit.sum(axis=0), fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True)) for _, x in good]
    return [i for i, _ in good], n, deviation, (np.array([x for _, x in good]) - mean) @ v / np.sqrt(e), e / np.trace(cov)


def test_whitening_equals_a_dense_solution(spark):
    made = vectors(200)
    ids, n, deviation, white, share = plain_whitening(made, 4)
    out = whitening.whitened(frame(spark, made)).toPandas()
    assert len(out) == 4 * len(ids) and set(out["n"]) == {n} and out["identity_error"].max() < 1e-9
    assert np.allclose([out[out["component"] == c + 1]["explained"].iloc[0] for c in range(4)], share, rtol=1e-10)
    for c in range(4):
        got = out[out["component"] == c + 1]
        want = sorted(zip([-1 if i is None else i for i in ids], deviation, white[:, c], strict=True))
        got = sorted(zip(got["vec_id"].fillna(-1).astype(int), got["deviation"], got["whitened"], strict=True))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        a, b = np.array([g[2] for g in got]), np.array([w[2] for w in want])
        assert np.allclose(a, b * np.sign(a @ b), atol=1e-9)


def test_whitening_without_variance(spark, rows):
    assert whitening.whitened(frame(spark, [])).count() == 0
    one = whitening.whitened(frame(spark, [(1, [0.5, 0.25], 1), (1, [0.5, 0.25], 2)]))
    assert rows(one, "component", "deviation", "whitened", "explained", "identity_error") == [(1, 0, 0.0, 0.0, 0.0)] * 2 + [(2, 0, 0.0, 0.0, 0.0)] * 2
    line = whitening.whitened(frame(spark, [(i, [i / 4, i / 2, 0.0], 1) for i in range(6)])).toPandas()
    assert np.allclose(sorted(set(line["explained"].round(9))), [0, 1]) and line["identity_error"].max() < 1e-9
    assert (line[line["component"] > 1]["whitened"] == 0).all()


def test_deviations_beyond_a_long_are_null():
    x, s = np.array([[3, -2], [1 << 30, 0]]), np.array([5, 7])
    assert whitening._deviation(x, 10, s) == [25 ** 2 + 27 ** 2, None]


def test_divide_and_conquer_on_hard_spectra():
    draw = np.random.default_rng(0)
    for n in (1, 2, 7, 40):
        q = np.linalg.qr(draw.standard_normal((n, n)))[0]
        for e in (draw.random(n), np.ones(n), np.zeros(n), 10.0 ** -np.arange(n), np.arange(n) % 3 - 1.0, np.r_[1.0, np.zeros(n - 1)],
                  np.r_[1.0, 1.0 - 1e-12, np.full(n, 0.5)][:n], np.arange(n) - (n - 1) / 2):
            a = q @ np.diag(e) @ q.T
            a = (a + a.T) / 2
            values, v = whitening.leading_components(a, 4)
            scale = max(1e-300, np.linalg.norm(a))
            assert np.allclose(values, np.sort(e)[::-1][:4], atol=1e-12 * scale)
            assert np.linalg.norm(a @ v - v * values) < 1e-12 * scale + 1e-300 and np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-12)


# ---- SimHash


def plain_print(text):
    w = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(prints, most=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, f in enumerate(prints):
        for j in range(i):
            if (int(f) ^ int(prints[j])).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def plain_classes(documents):
    prints = sorted({plain_print(t) for _, t in documents})
    root = dict(zip(prints, plain_roots(prints), strict=True))
    least = {}
    for i, t in documents:
        r = root[plain_print(t)]
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [(i, f"{plain_print(t):016x}", least[root[plain_print(t)]]) for i, t in documents]


def test_classes_of_awkward_documents(spark, rows, docs, rows_of_documents):
    """All cases of the shared table, under clashing names; small groups, so that hot cuts are cut again."""
    want = sorted(plain_classes([d[:2] for d in rows_of_documents]), key=repr)
    for large in (simhash.LARGE, 3):
        assert rows(simhash.simhash_classes(docs, large=large)) == want


def test_classes_of_an_empty_table(no_docs):
    assert simhash.simhash_classes(no_docs).count() == 0


@pytest.mark.parametrize("bits, n, large", [(9, 300, 20), (14, 400, 40), (64, 200, 5), (5, 32, 1)])
def test_links_under_shared_bits(spark, bits, n, large):
    """Fingerprints that differ in a few of their bits only, so that nearly all share two of three cuts."""
    draw = np.random.default_rng(bits)
    where = np.sort(draw.permutation(64)[:bits]).astype(np.uint64)
    values = draw.integers(0, 2, (n, bits)).astype(np.uint64)
    prints = np.unique((values << where).sum(axis=1, dtype=np.uint64) ^ np.uint64(0x0123456789ABCDEF))
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    edges = simhash._links(frame, 2, large).collect()
    # each edge joins two prints of one class, and together they join the whole class
    want = plain_roots(prints.tolist())
    place = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(prints))] == want


def test_index_finds_all_pairs_within_the_limit():
    draw = np.random.default_rng(4)
    for n, bits, most in ((1, 60, 2), (15, 4, 1), (500, 12, 2), (700, 18, 3), (300, 62, 2)):
        f = np.unique(draw.integers(0, 1 << bits, n).astype(np.uint64))
        f = draw.permutation(f)
        want = {(i, j) for i in range(len(f)) for j in range(len(f)) if (int(f[i]) ^ int(f[j])).bit_count() <= most}
        got = {(int(a), int(b)) for q, p in simhash.GrayIndex(f).within(f, most) for a, b in zip(q, p, strict=True)}
        assert got == want


def test_gray_ranks_put_neighbours_one_bit_apart():
    f = np.arange(1024, dtype=np.uint64)
    in_order = f[np.argsort(simhash.gray_rank(f))]
    assert all((int(a) ^ int(b)).bit_count() == 1 for a, b in pairwise(in_order))


def test_fingerprints_of_short_and_long_texts():
    draw = random.Random(2)
    for n in (0, 1, 2, 3, 4, 255, 256, 257, 258, 700):
        text = " \n".join(draw.choice(["A", "bé", "Cc", "ddd"]) for _ in range(n))
        assert simhash.fingerprint(text) == plain_print(text)
