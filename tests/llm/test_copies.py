import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from hazegrid.llm import exact_dedup, jaccard_join, mixing, packing, toxicity


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def plain_groups(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(normal(t), []).append(d)
    return groups


@pytest.mark.parametrize("limit", [exact_dedup.BUCKET_BYTES, 400])
def test_exact_dedup(docs, rows_of_documents, limit):
    got = exact_dedup.exact_dedup(docs, limit=limit).collect()
    groups = plain_groups((d, t) for d, t, *_ in rows_of_documents)
    want = Counter()
    for d, t, *_ in rows_of_documents:
        g = groups[normal(t)]
        keep = min((x for x in g if x is not None), default=None)
        want[d, keep, len(g), hashlib.sha256(normal(t).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_one_hot_text_and_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FEW", 2)
    rows = [(i, "the same long text " * 3) for i in range(400)] + [(1000 + i, f"text {i % 150}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    got = exact_dedup.exact_dedup(df, limit=60).collect()
    groups = plain_groups(rows)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(d, min(groups[normal(t)]), len(groups[normal(t)])) for d, t in rows}
    kept = exact_dedup.distinct_documents(df, limit=60).collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(g) for g in groups.values())


def test_whole_rows_stay(docs, no_docs, rows_of_documents):
    kept = exact_dedup.distinct_documents(docs)
    assert kept.columns == docs.columns
    groups = plain_groups((d, t) for d, t, *_ in rows_of_documents)
    rows = kept.collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(min((x for x in g if x is not None), default=None)) for g in groups.values())
    texts = {(d, t) for d, t, *_ in rows_of_documents}
    assert all((r.doc_id, r.text) in texts and r.key == "clash" for r in rows)
    assert exact_dedup.distinct_documents(no_docs).count() == 0 and exact_dedup.exact_dedup(no_docs).count() == 0


def test_the_table_compares_contents():
    table = exact_dedup.ContentTable()
    rows = [(7, f"t{i % 100}") for i in range(500)]  # one hash for all
    owners = [table.owner(h, t, i) for i, (h, t) in enumerate(rows)]
    assert owners == [i % 100 for i in range(500)]


# ---- near duplicates


def plain_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    sets = [(d, plain_set(t)) for d, t in rows]
    parent, links = list(range(len(sets))), Counter()

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
                links.update((i, j))
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i)) if s else d, links[i]) for i, (d, s) in enumerate(sets))


def close_texts(seed, families, copies):
    draw = random.Random(seed)
    out = []
    for _ in range(families):
        base = [f"w{draw.randrange(500)}" for _ in range(draw.choice([3, 6, 12, 40, 90, 200]))]
        for _ in range(draw.randrange(1, copies)):
            words = list(base)
            for _ in range(draw.randrange(0, max(2, len(words) // 20))):
                at = draw.randrange(len(words))
                words[at:at + 1] = draw.choice([[], [f"x{draw.randrange(9)}"], [words[at], "Y"], [words[at].upper()]])
            out.append((len(out), " ".join(words)))
    return out


@pytest.mark.parametrize("tiles", [1500, 3])
def test_components(spark, docs, rows_of_documents, tiles, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_POSTINGS", 150)
    rows = [(d, t) for d, t, *_ in rows_of_documents] + [(5000 + d, t) for d, t in close_texts(2, 25, 9)]
    rows += [(9000, "shared passage of more than five words that many have " + " ".join(f"own{i}" for i in range(8)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_join.ngram_jaccard(df, tile_rows=tiles).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == plain_components(rows)


def test_edges_of_the_join(docs, no_docs, rows_of_documents):
    got = jaccard_join.ngram_jaccard(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == plain_components((d, t) for d, t, *_ in rows_of_documents)
    assert jaccard_join.ngram_jaccard(no_docs).count() == 0


def test_rows_that_share_an_id(spark, monkeypatch):
    """Many texts under no id, and one text many times under one id, are told apart and counted."""
    monkeypatch.setattr(jaccard_join, "CHUNK_POSTINGS", 300)
    texts = [t for _, t in close_texts(8, 12, 7)]
    rows = [(None, t) for t in texts] + [(1, t) for t in texts[::3]] + [(2, texts[0])] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for tiles in (1500, 4):
        got = jaccard_join.ngram_jaccard(df, tile_rows=tiles).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == plain_components(rows)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.booleans())
def test_links_of_a_tile(seed, narrow):
    sets = [s for s in (jaccard_join.shingles(t) for _, t in close_texts(seed, 8, 9)) if len(s)]
    side = np.arange(len(sets)) % 2
    plain = [set(s.tolist()) for s in sets]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(plain[i] & plain[j]) >= 75 * len(plain[i] | plain[j])}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(jaccard_join, "BIT_BYTES", 0 if narrow else 1 << 20)
        m.setattr(jaccard_join, "STEP_BYTES", 100)
        a, b = jaccard_join.links(sets)
        found = [tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert sorted(found) == sorted(want)
        c, d = jaccard_join.links(sets, side=side)
        assert {tuple(sorted(p)) for p in zip(c.tolist(), d.tolist(), strict=True)} == {p for p in want if side[p[0]] != side[p[1]]}
    label = jaccard_join.classes(len(sets), a, b).tolist()
    assert all(label[i] == label[j] for i, j in want)
    assert len(set(label)) == len({c for _, _, c, _ in plain_components([(i, t) for i, t in close_texts(seed, 8, 9) if t])})


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10_000))
def test_linked_sets_share_enough_of_their_fronts(n, seed):
    draw = random.Random(seed)
    a = draw.sample(range(10**6), n)
    change = draw.randrange(0, max(1, n // 7) + 1)
    b = a[change:] + draw.sample(range(10**6, 2 * 10**6), draw.randrange(0, change + 1))
    a, b = set(a), set(b)
    if b and 100 * len(a & b) >= 75 * len(a | b):
        front = [set(sorted(s, key=lambda x: hash((x, seed)))[:jaccard_join._front(len(s))]) for s in (a, b)]
        assert len(front[0] & front[1]) >= max(jaccard_join._front_shared(len(a)), jaccard_join._front_shared(len(b)))


# ---- the pipeline


def test_pipeline_stage_by_stage(spark, docs, tmp_path):
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(20)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    now, labels = docs, spark.read.parquet(f"{sf}/labels.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in now.collect()]
        out = stage(spark, now, sf)
        path = str(tmp_path / f"stage{i}")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        after = [r.asDict() for r in out.collect()]
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxicity(now, labels).collect() if r.predicted}
            want = [r for r in before if r["doc_id"] not in bad]
        elif name == "exact_dedup":
            want = {}
            for r in sorted(before, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
                want.setdefault(normal(r["text"]), r)
            want = list(want.values())
        elif name == "ngram_jaccard":
            found = plain_components((r["doc_id"], r["text"]) for r in before)
            gone = {d for d, _, c, _ in found if d is not None and d != c}
            want = [r for r in before if r["doc_id"] not in gone]
        elif name == "mixing":
            passes = {r.doc_id: len(r.positions) for r in mixing.curriculum_mix(now).collect()}
            want = [r for r in before for _ in range(passes[r["doc_id"]])]
        else:
            want = [r.asDict() for r in packing.best_fit_packing(now).collect()]
        key = (lambda r: str((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]))) if name == "packing" else str
        assert sorted(map(key, after)) == sorted(map(key, want)), name
        if name != "packing":
            assert out.columns == docs.columns
        now = out
    got = corpus_pipeline.run(spark, sf).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert Counter(map(tuple, got)) == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after)


def test_pipeline_on_an_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
