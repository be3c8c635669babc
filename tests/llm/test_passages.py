from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from tessera.llm import anchors, debruijn, suffix_dedup


def byte_rows():
    return brute.fragments(3, 150, "abcdefgh é", "", 700)


def word_rows():
    return brute.fragments(5, 150, [f"w{i}" for i in range(300)] + ["é", "The"], " ", 200)


def passages(df, **kw):
    return {r[0]: tuple(r)[1:] for r in suffix_dedup.dedup_passages(df, digest=True, **kw).collect()}


def substrings(df):
    return {r[0]: tuple(r)[1:] for r in debruijn.dedup_substrings(df, digest=True).collect()}


def test_deep_shallow_sort_orders_bytes():
    rng = random.Random(3)
    for _ in range(100):
        base = [bytes(rng.choice(b"ab") for _ in range(104)) for _ in range(4)]
        texts = []
        for _ in range(rng.randrange(1, 60)):
            b = bytearray(rng.choice(base))
            for _ in range(rng.randrange(3)):
                b[rng.randrange(104)] = rng.choice(b"abc")
            texts.append(bytes(b))
        m = np.frombuffer(b"".join(texts), dtype=np.uint8).reshape(len(texts), 104)
        order, shared = suffix_dedup.deep_shallow_sort(m, suffix_dedup._keys(m, 104))
        got = [texts[i] for i in order]
        assert got == sorted(texts)
        for a, b, n in zip(got, got[1:], shared[1:]):
            assert n == next((k for k in range(104) if a[k] != b[k]), 104)


def test_anchors_do_not_depend_on_the_stretch():
    rng = np.random.default_rng(5)
    h = rng.integers(1 << 63, (1 << 64) - 1, 10, dtype=np.uint64)
    h[2], h[6] = np.uint64((5 << 32) + 9), np.uint64((5 << 32) + 8)  # agree in 32 bits, and further in far fewer than 64
    alone = anchors.Units(h, np.array([10]), memoryview(h).cast("B"), 8)
    other = rng.integers(1 << 63, (1 << 64) - 1, 1 << 20, dtype=np.uint64)
    both = np.concatenate((other, h))
    beside = anchors.Units(both, np.array([1 << 20, 10]), memoryview(both).cast("B"), 8)
    a, b = anchors.blocks(alone, 10, 1), anchors.blocks(beside, 10, 1)
    mine = b[0] == 1
    assert [x.tolist() for x in (a[2], a[3], a[4])] == [x[mine].tolist() for x in (b[2], b[3], b[4])] == [[1], [2], [int(h[2])]]


def test_passages_beside_much_other_text(spark):
    rows = byte_rows()[:60]
    rng = random.Random(1)
    other = [(10_000 + i, "".join(map(chr, rng.choices(range(33, 120), k=1 << 21)))) for i in range(2)]
    alone = passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    beside = passages(spark.createDataFrame(rows + other, "doc_id long, text string").coalesce(1))
    assert {k: beside[k] for k in alone} == alone


@pytest.mark.parametrize("run", [passages, substrings])
def test_ids_with_different_texts(spark, run):
    long = " ".join(f"x{i}" for i in range(400))
    rows = [(1, long), (2, long), (3, "a"), (3, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    operator = suffix_dedup.dedup_passages if run is passages else debruijn.dedup_substrings
    got = sorted((r.doc_id, r.n_removed > 0) for r in operator(df).collect())
    assert got == [(1, run is substrings), (2, True), (3, False), (3, False)]


def test_passages_as_brute_force(spark):
    rows = byte_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert passages(df) == brute.passages({d: (t or "").encode() for d, t in rows})


def test_passages_by_windows_and_dealt_out(spark, monkeypatch):
    rows = byte_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(anchors, "HEAVY", 30)
    whole = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda d, n: whole(d, n, group=20))
    assert passages(df) == brute.passages({d: (t or "").encode() for d, t in rows})


def test_substrings_as_brute_force(spark, monkeypatch):
    rows = word_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute.substrings(rows)
    assert substrings(df) == want
    monkeypatch.setattr(anchors, "HEAVY", 30)
    assert substrings(df) == want


@pytest.mark.parametrize("run", [passages, substrings])
def test_edge_cases(spark, run):
    schema = "doc_id long, text string, start int, spans string"
    assert run(spark.createDataFrame([], schema)) == {}
    long = " ".join(f"x{i % 1000}" for i in range(4000))
    rows = [(1, None, 0, "a"), (2, "", 0, "a"), (3, "short", 0, "a"), (4, long, 0, "a"), (4, long, 0, "a"), (None, long, 0, "a")]
    got = run(spark.createDataFrame(rows, schema))
    assert set(got) == {1, 2, 3, 4, None} and got[1] == got[2] and got[3][1] == 0 and got[None][1] == 0
    want = brute.passages({4: long.encode()})[4] if run is passages else brute.substrings([(4, long)])[4]
    assert got[4] == want  # the repeated row counts once


def test_compacted_paths_have_one_source(spark):
    text = " ".join(f"v{i * i % 9973}" for i in range(300))
    df = spark.createDataFrame([(1, f"{text} x"), (2, f"y {text}"), (3, f"z z {text}")], "doc_id long, text string")
    spans = debruijn.compacted_spans(debruijn.repeated_edges(df)).collect()
    assert {(r.source_doc, r.source_start) for r in spans} and all(r.source_doc == 1 for r in spans if r.stop - r.start > 100)
    assert {r.doc_id for r in spans} == {1, 2, 3}
