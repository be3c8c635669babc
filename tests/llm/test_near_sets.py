"""The pipeline's near-duplicates: five-word similarity of 0.8 or more, against brute force."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from tessera.llm import near_sets


def sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def linked(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def components(found):
    label = list(range(len(found)))
    for i in range(len(found)):
        for j in range(i):
            if linked(found[i], found[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def copies():
    """Copies at similarities from below 0.8 to 0.99, of short and long texts, and a group with a shared passage."""
    rng = random.Random(4)
    texts = []
    for n in (40, 100, 200, 500, 1000):
        for _ in range(4):
            base = [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(n)]
            texts.append(" ".join(base))
            for share in (0.005, 0.01, 0.015, 0.02, 0.023, 0.03):
                w = list(base)
                for at in rng.sample(range(n), max(1, round(share * n))):
                    w[at] = f"new{rng.randrange(10**6)}"
                texts.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [" ".join(f"own{i}x{j}" for j in range(60)) + " " + passage for i in range(20)]
    return texts + ["one two", "ONE  two", "one two three", "", " \t", None]


def test_stage_finds_every_copy_of_similarity_080(spark):
    texts = copies()
    found = sets(texts)
    assert sum(0.8 <= len(a & b) / len(a | b) <= 0.95 for i, a in enumerate(found) for b in found[:i] if a | b) > 100
    df = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.dedup_near(spark, df.repartition(3), "").collect()}
    assert got == {i for i, c in enumerate(components(found)) if i == c}


def test_ids_that_repeat_or_are_null(spark):
    rows = [(4, "a b c d e f"), (4, "q r s"), (9, "a b c d e f"), (None, "q r s"), (None, "x y z")]
    got = near_sets.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4), (4, 4), (9, 4)]
    assert near_sets.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_in_several_blocks(spark):
    texts = copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_sets.near_duplicates(df, block=3).collect()}
    assert got == dict(enumerate(components(sets(texts))))


def test_one_row_of_each_component(spark):
    rows = [(4, "a b c d e f", "x"), (4, "a b c d e f", "x"), (9, "A b c d e f", "y"), (None, "q r s", "z"), (None, "q r s", "z"), (None, "", "w"), (7, None, "w"), (None, "own text", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = near_sets.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(4, "a b c d e f", "x"), (None, "q r s", "z"), (7, None, "w"), (None, "own text", "v")], key=repr)
    assert near_sets.one_of_each(df.limit(0)).count() == 0


def test_repeated_shingles_do_not_hide_a_link(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " " + " ".join(["w55 w56 w57 w58 w59"] * 400))]
    assert near_sets.linked_sets([near_sets.shingles(t.encode()) for _, t in rows]).tolist() == [0, 0]


def test_links_of_a_group_are_followed_from_set_to_set():
    chain = [np.arange(i, i + 20, dtype=np.int64) for i in range(0, 60, 2)] + [np.arange(500, 520, dtype=np.int64)]
    assert near_sets.linked_sets(chain).tolist() == [0] * 30 + [30]


def test_tiles_of_fingerprints_find_the_links_of_all_pairs():
    from tessera.llm.simhash import majority

    rng = np.random.default_rng(5)
    base = [rng.integers(-(1 << 62), 1 << 62, 60) for _ in range(12)]
    found = [np.unique(np.concatenate([rng.choice(b, 60 - n, replace=False), rng.integers(-(1 << 62), 1 << 62, n)])) for b in base for n in range(0, 12, 2)]
    prints = [majority(s) for s in found]
    label = list(range(len(found)))
    for i in range(len(found)):
        for j in range(i):
            both = len(np.intersect1d(found[i], found[j]))
            if 5 * both >= 4 * (len(found[i]) + len(found[j]) - both) and (prints[i] ^ prints[j]).bit_count() <= near_sets.RADIUS and label[i] != label[j]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert len(set(label)) > 12
    for tile in (1, 7, 2048):
        assert near_sets.linked_sets(found, tile=tile).tolist() == label


def test_full_batches_of_texts_are_worked_on_in_portions():
    import pyarrow as pa

    texts = [f"{i} " + "same words again and again " * 80 for i in range(4_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i).encode() for i in range(len(texts))]), pa.array(texts)], names=["key", "text"])
    for of_text, run in ((near_sets.shingles, near_sets._sets(5)), (lambda t: near_sets.bands(near_sets.shingles(t)), near_sets._signed(5))):
        found = list(run(iter([batch])))
        assert len(found) > 1
        rows = [tuple(r.values()) for x in found for r in x.to_pylist()]
        assert [k for k, _ in rows] == batch["key"].to_pylist()
        assert rows[-1][1] == of_text(texts[-1].encode()).tolist()


def test_pairs_that_fingerprints_or_bands_lose_are_linked(spark, monkeypatch):
    base = " ".join(f"a7224x{j}" for j in range(8))
    a, b = (near_sets.shingles(x.encode()) for x in (base, base + " z64"))
    assert (len(np.intersect1d(a, b)), len(b)) == (4, 5)  # a similarity of 0.8 at 32 differing bits
    assert near_sets.linked_sets([a, b]).tolist() == [0, 1]
    rows = [(1, base), (2, base + " z64"), (3, " ".join(f"a7224x{j}" for j in range(7)))]
    got = near_sets.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 3)]
    texts = copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(components(sets(texts))))
    monkeypatch.setattr(near_sets, "connected_components", lambda links, found=near_sets.connected_components, calls=[]: (calls.append(1), found(links.limit(9) if len(calls) < 3 else links))[1])
    assert {r.doc_id: r.component_id for r in near_sets.near_duplicates(df).collect()} == want  # hardly any link by bands


def test_prefixes_of_similar_sets_have_enough_in_common():
    rng = np.random.default_rng(3)
    for n in range(1, 160):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        for gone in range(n):
            kept = np.sort(rng.choice(a, n - gone, replace=False))
            more = rng.integers(0, max(1, n // 4))
            b = np.unique(np.concatenate([kept, rng.integers(-(1 << 62), 1 << 62, more)]))
            if 5 * (n - gone) < 4 * (n + len(b) - (n - gone)):
                break
            (p, least), (q, most) = near_sets.prefix(a), near_sets.prefix(b)
            assert len(np.intersect1d(p, q)) >= max(least, most)


def test_the_rest_is_what_all_pairs_link():
    rng = np.random.default_rng(7)
    common = rng.integers(-(1 << 62), 1 << 62, 25)
    base = [np.concatenate([common, rng.integers(-(1 << 62), 1 << 62, n)]) for n in (0, 5, 20, 40, 90)]
    found = [np.unique(np.concatenate([rng.choice(b, len(b) - k, replace=False), rng.integers(-(1 << 62), 1 << 62, k)])) for b in base for k in (0, 0, 1, 2, 3, 5, 8, 13)]
    start = rng.integers(0, 30, len(found))
    label = start.tolist()
    for i in range(len(found)):
        for j in range(i):
            both = len(np.intersect1d(found[i], found[j]))
            if 5 * both >= 4 * (len(found[i]) + len(found[j]) - both) and label[i] != label[j]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert 1 < len(set(label)) < len(set(start.tolist()))
    assert near_sets.linked_rest(found, start).tolist() == [label.index(x) for x in label]


def test_hashes_that_several_rows_hold():
    import pyarrow as pa

    rng = np.random.default_rng(11)
    rows = [0, 1, 2, 70_000, 70_001, (1 << 33) + 5, (1 << 33) + 6, 4]  # two files of a task, and a third out of order
    held = [np.unique(np.append(rng.integers(0, 40, 25), rng.integers(-(1 << 62), 1 << 62, 5))) for _ in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array([h.tolist() for h in held], pa.list_(pa.int64()))], names=["row", "hashes"])
    for buckets in (1, 8):
        dealt = sorted((r for x in near_sets._dealt(buckets)([batch]) for r in x.to_pylist()), key=lambda r: r["bucket"])
        sorted_ = pa.RecordBatch.from_pylist(dealt, schema=next(near_sets._dealt(buckets)([batch])).schema)
        got = {(r["row"], r["hash"]) for x in near_sets._met(buckets)([sorted_]) for r in x.to_pylist()}
        count = {h: sum(h in o.tolist() for o in held) for o in held for h in o.tolist()}
        assert got == {(r, h) for r, o in zip(rows, held) for h in o.tolist() if count[h] > 1}
