from __future__ import annotations

import hashlib
import math
import os
from collections import Counter

import numpy as np
import pytest

from tessera.llm import segment_sampling, token_counts
from tessera.llm.pieces import MODEL, read_model, vocabulary

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="the vocabulary file is not here")


@pytest.fixture(scope="module")
def v():
    return vocabulary(read_model())


def segmentations(v, w: bytes):
    by = {t: i for i, t in enumerate(v.text) if t and v.byte_id[t[0]] != i}

    def go(i):
        if i == len(w):
            yield (), 0.0
            return
        n = 1
        while i + n < len(w) and (w[i + n] & 0xC0) == 0x80:
            n += 1
        if w[i : i + n] not in by:
            ids = tuple(int(v.byte_id[b]) for b in w[i : i + n])
            for rest, p in go(i + n):
                yield ids + rest, p + sum(v.logp[x] for x in ids)
        for j in range(i + 1, len(w) + 1):
            if w[i:j] in by:
                for rest, p in go(j):
                    yield (by[w[i:j]],) + rest, p + v.logp[by[w[i:j]]]

    return list(go(0))


def test_forward_scores_as_brute_force(v):
    words = [b" hello", b" and", b" an", b"\n", "  ▁é".encode(), " ñá¤".encode(), b" "]
    counts, best, total = token_counts.forward(words, v)
    for w, c, b, t in zip(words, counts, best, total):
        every = segmentations(v, w)
        top = max(p for _, p in every)
        assert b == pytest.approx(top) and t == pytest.approx(np.logaddexp.reduce([p for _, p in every]))
        assert c == min(len(s) for s, p in every if abs(p - top) < 1e-12)


def test_top_two_follow_the_law_without_replacement(v):
    lattice = segment_sampling.Lattice([b" an", b"\n"], v)
    every = dict(segmentations(v, b" an\n"))
    z = np.logaddexp.reduce(list(every.values()))
    p = {s: math.exp(x - z) for s, x in every.items()}
    n = 20_000
    seeds = segment_sampling.mix(np.arange(n).astype(np.uint64))
    paths, threshold = segment_sampling.sample_segmentations(lattice, np.tile([0, 1], n), np.full(n, 2), seeds, 2)
    one, two = ([tuple(lattice.token[q.edges[o : o + c]].tolist()) for o, c in zip(q.offset, q.count)] for q in paths)
    pairs = Counter(zip(one, two))
    assert all(a != b for a, b in pairs)
    for a in p:
        for b in p:
            if a != b:
                assert abs(pairs[a, b] / n - p[a] * p[b] / (1 - p[a])) < 0.02
    inclusion = sum((np.exp(q.logp) / -np.expm1(-np.exp(q.logp - threshold[q.doc]))).sum() for q in paths) / n
    assert inclusion == pytest.approx(1, abs=0.02)  # Horvitz-Thompson estimate of the total probability


ROWS = [(1, "Hello  world \n\nfoo\tbar é ▁ 梦 "), (2, None), (3, ""), (4, " "), (5, "a" * 3000), (6, "the and " * 2000), (None, "no id")]


def test_round_trip_and_distinct_samples(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, ids string").repartition(3)
    got = segment_sampling.decode(segment_sampling.encode_samples(df, samples=3)).collect()
    texts = dict(ROWS)
    by: dict = {}
    for r in got:
        assert r.text == (texts[r.doc_id] or "") and r.log_inclusion <= 0 and r.log_prob <= 1e-9
        by.setdefault(r.doc_id, []).append(r)
    assert {k: len(x) for k, x in by.items() if k in (2, 3)} == {2: 1, 3: 1}
    for rows in by.values():
        rows.sort(key=lambda r: r["sample"])
        assert len({tuple(r.ids) for r in rows}) == len(rows)
        assert [r.perturbed for r in rows] == sorted((r.perturbed for r in rows), reverse=True)


def test_decoded_digests(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    texts = dict(ROWS)
    for r in segment_sampling.encode_samples(df, decoded=True).collect():
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_samples_depend_on_the_row_alone(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    all_ = {(r.doc_id, r["sample"]): tuple(r) for r in segment_sampling.encode_samples(df.coalesce(1)).collect()}
    one = {(r.doc_id, r["sample"]): tuple(r) for r in segment_sampling.encode_samples(df.filter("doc_id = 1")).collect()}
    assert one and all(all_[k] == x for k, x in one.items())


def test_token_counts_edge_cases(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS + [ROWS[0]]], "doc_id long, text string, n_tokens int")
    got = token_counts.count_tokens(df).collect()
    assert len(got) == len(ROWS) + 1
    by = {r.doc_id: r for r in got}
    assert by[2].n_tokens == by[3].n_tokens == 0 and by[4].n_tokens == 1
    assert all(r.best_log_prob <= r.log_likelihood + 1e-9 for r in got)
    assert token_counts.count_tokens(df.limit(0)).count() == 0
    assert segment_sampling.encode_samples(df.limit(0)).count() == 0


def test_the_search_draws_for_all_texts_at_once_and_decodes_whole_runs(monkeypatch):
    import numpy as np

    from tessera.llm import segment_sampling as g
    from tessera.llm.pieces import pre_tokens, read_model, vocabulary

    v, calls, draw = vocabulary(read_model()), [], g.uniform
    monkeypatch.setattr(g, "uniform", lambda *a: calls.append(1) or draw(*a))
    texts = [f"wort {i} ünd {'naïve ' * (i % 3)}\u2581 x".encode() for i in range(200)]

    def sampled(some, first=0):
        words, at, lengths = pre_tokens(some)
        lattice = g.Lattice(words, v)
        seeds = g.mix(np.arange(first, first + len(some)).astype(np.uint64))
        del calls[:]
        return lattice, g.sample_segmentations(lattice, at, lengths, seeds, 3), len(calls)

    lattice, (paths, _), n = sampled(texts)
    assert n < len(texts)
    alone, (one, _), _ = sampled(texts[7:8], 7)
    for p, q in zip(paths, one):
        i = p.doc.tolist().index(7)
        assert p.value[i] == q.value[0] and p.logp[i] == q.logp[0]
        ids = lattice.token[p.edges].astype(np.int32)
        assert ids[p.offset[i] : p.offset[i] + p.count[i]].tolist() == alone.token[q.edges].tolist()
        ends = np.concatenate(([0], np.cumsum(p.count)))
        assert [bytes(t) for t in v.decode_runs(ids, ends)] == [texts[d] for d in p.doc]
    assert [bytes(t) for t in v.decode_runs(np.zeros(0, np.int32), np.zeros(3, np.int64))] == [b"", b""]


def test_a_stretch_leaves_nothing_for_the_collector():
    import gc

    from tessera.llm.pieces import pre_tokens

    gc.collect()
    gc.disable()
    try:
        words, at, lengths = pre_tokens([b"a new word and a new word", b"", b"another\nword"])
        assert gc.collect() == 0
    finally:
        gc.enable()
    assert words == [b" a", b" new", b" word", b" and", b" another", b"\n", b"word"]
    assert at.tolist() == [0, 1, 2, 3, 0, 1, 2, 4, 5, 6] and lengths.tolist() == [7, 0, 3]


def test_full_batches_are_encoded_in_portions(spark, monkeypatch):
    import pyarrow as pa

    rows = spark.range(0).selectExpr("id as doc_id", "'' as text")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: run)
    held, bytes_of = [], segment_sampling.bytes_of
    monkeypatch.setattr(segment_sampling, "bytes_of", lambda column: held.append(len(column)) or bytes_of(column))
    texts = ["some words " * 2_500 + str(i) for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    found = [r for x in segment_sampling.encode_samples(rows, decoded=True)(iter([batch])) for r in x.to_pylist()]
    assert len(held) > 1 and sum(held) == 200
    assert sorted((r["doc_id"], r["sample"]) for r in found) == [(i, s) for i in range(200) for s in (1, 2)]
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in found)
