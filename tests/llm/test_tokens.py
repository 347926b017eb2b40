from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hazegrid.llm import bpe, packing, token_files
from hazegrid.llm.token_counts import token_counts


def test_whole_tokens_are_proven():
    tok = bpe.library()
    proven = bpe.whole_tokens()
    assert len(proven) > 30_000
    for piece, i in list(proven.items())[::997]:
        assert [t.id for t in tok.model.tokenize(piece)] == [i]


def test_every_safe_character_next_to_others(library_ids):
    table = bpe.Words()
    for point in [*range(0x250), *range(0x2010, 0x2060), *range(0x20A0, 0x20C0)]:
        for text in (f"ab{chr(point)}cd {chr(point)}", f"{chr(point)}'s x{chr(point)}9{chr(point)}"):
            assert table.ids([text])[0].tolist() == library_ids(text), hex(point)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_ids_and_counts_equal_the_library(texts):
    tok = bpe.library()
    table = bpe.Words(limit=50)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in table.ids(texts)] == want
    assert table.counts(texts).tolist() == [len(x) for x in want]


def test_token_counts(docs, no_docs, rows_of_documents, library_ids):
    got = Counter(map(tuple, token_counts(docs, limit=20).collect()))
    assert got == Counter((d, len((t or "").encode()), n := len(library_ids(t)), n > 20) for d, t, *_ in rows_of_documents)
    assert token_counts(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=700), st.integers(1, 9))
def test_coding_round_trip_from_every_checkpoint(ids, lanes):
    ids = np.array(ids, np.int64)
    symbols, counts = np.unique(np.append(ids, [0, 49_000]), return_counts=True)
    table = token_files.Table.of(symbols, counts)
    assert table.freq.sum() == 1 << token_files.BITS and table.freq.min() >= 1
    token_files_every, token_files.EVERY = token_files.EVERY, 16
    try:
        coded, marks = token_files.encode(ids, table, lanes)
    finally:
        token_files.EVERY = token_files_every
    if len(ids):
        assert token_files.decode(coded, marks, len(ids), table, lanes).tolist() == ids.tolist()
        parts = [token_files.decode(coded, marks, len(ids), table, lanes, i, i + 1) for i in range(len(marks))]
        assert np.concatenate(parts).tolist() == ids.tolist()


def test_token_files(spark, docs, no_docs, rows_of_documents, library_ids, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 20_000)
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path)
    got = token_files.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    want = Counter((d, tuple([*library_ids(t), 2])) for d, t, *_ in rows_of_documents)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    named = [r.doc_id for r in got if r.doc_id is not None]
    assert named == sorted(named) and got[0].doc_id is None
    assert all(r.ids_crc32 == crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert spark.read.parquet(f"{path}/blocks").select("shard").distinct().count() > 1
    assert token_files.token_files(no_docs).count() == 0


def test_damage_is_noticed(spark, docs, tmp_path):
    from pyspark.sql import functions as F
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    bad = str(tmp_path / "bad")
    for part in ("table", "shards"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{bad}/{part}")
    blocks.withColumn("coded", F.concat(F.expr("substring(coded, 1, octet_length(coded) - 1)"), F.lit(b"\x07"))).write.parquet(f"{bad}/blocks")
    with pytest.raises(Exception, match="damaged"):
        token_files.read_token_files(spark, bad).count()


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_a_plan_places_each_item_once(case):
    capacity, items = case
    count = dict(Counter(items))
    plan = packing.pack_lengths(count, capacity)
    bins, order = {}, sorted(plan.rows)
    for k, (length, begun, first, each, offset) in enumerate(order):
        end = order[k + 1][1] if k + 1 < len(order) and order[k + 1][0] == length else count[length]
        for r in range(begun, end):
            bins.setdefault(first + (r - begun) // each, []).append((offset + (r - begun) % each * length, length))
    assert plan.used == count and len(bins) == plan.bins
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    # no worse than plain first fit over the same items, longest first
    plain = []
    for x in sorted(items, reverse=True):
        for b in plain:
            if sum(b) + x <= capacity:
                b.append(x)
                break
        else:
            plain.append([x])
    assert plan.bins <= len(plain) + 1


def _least_bins(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1:]])
        go(i + 1, [*bins, items[i]])
    go(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_the_reduction_loses_nothing(items):
    items = sorted(items, reverse=True)
    plan = packing.Plan()
    left = packing.reduce_dominated(dict(Counter(items)), 20, plan)
    rest = sorted((x for x, n in left.items() for _ in range(n)), reverse=True)
    assert plan.bins + _least_bins(rest, 20) == _least_bins(items, 20)


def test_best_fit_packing(docs, no_docs, rows_of_documents, library_ids, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 5)
    got = packing.best_fit_packing(docs, capacity=64).collect()
    want = Counter()
    for d, t, *_ in rows_of_documents:
        ids = [*library_ids(t), 0]
        want.update((d, k, a, len(ids[a:a + 64]), crc32(np.array(ids[a:a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(held) <= 1.02 * sum(r.length for r in got) / 64 + 1
    assert packing.best_fit_packing(no_docs).count() == 0


def test_the_table_of_words_is_bounded_in_bytes(library_ids):
    """Long words are encoded and not kept; many words, many bytes or many ids start the table again; counts stay those of the library."""
    from hazegrid.llm import bpe

    table = bpe.Words(limit=50, limit_bytes=2_000)
    texts = ["x" * 20_000 + f" word{i} " + "é" * 40 + f" a{i}b " + "ab3" * 30 for i in range(40)]
    for t in texts + texts[:3]:
        assert table.counts([t]).tolist() == [len(library_ids(t))]
        assert table.ids([t])[0].tolist() == library_ids(t)
        assert max(map(len, [*table, *table.pieces]), default=0) <= bpe.KEPT_BYTES
        # one slice may go beyond the limits, the next begins anew
        assert table.bytes <= 2_000 + 2 * bpe.KEPT_BYTES and len(table) <= 52
