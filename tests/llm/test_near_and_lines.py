from __future__ import annotations

import random
import time
from itertools import combinations

import brute
import numpy as np

from tessera.llm import line_dedup, simhash
from tessera.llm.components import connected_components


def near_rows():
    rng = random.Random(9)
    base = [[rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(120)] for _ in range(12)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "Zz"
        rows.append((i * 2 + 1, " ".join(w)))
    return rows + [(1001, None), (1002, " \t"), (1003, "one two"), (1004, "ONE two"), (1005, "ß É")]


def test_near_duplicates_as_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string").repartition(5)
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()))
    prints = [brute.fingerprint(t) for _, t in rows]
    assert got == [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute.components([i for i, _ in rows], prints))]


def test_near_duplicates_edge_cases(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (None, "q r s t")], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def test_tile_links_skip_only_far_tiles():
    rng = np.random.default_rng(1)
    fp = np.unique(rng.integers(0, 1 << 62, 40, dtype=np.uint64)[rng.integers(0, 40, 600)] ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)))
    small, large = simhash.tile_links(fp, 2, tile=7), simhash.tile_links(fp, 2, tile=4096)
    assert (small == large).all()
    label = brute.components(list(range(len(fp))), fp)
    assert small.tolist() == label


def test_buckets_beyond_a_tile(spark):
    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 1 << 16, 5000, dtype=np.uint64)) | np.uint64(0xABCD << 32)  # one bucket: the other bits agree
    assert len(fp) > 2 * simhash.TILE
    rows = spark.createDataFrame([(0, 7, int(f), i) for i, f in enumerate(fp)], "choice int, bucket long, fp long, node long").coalesce(1)
    pairs = rows.mapInArrow(simhash._bucket_links(simhash.RADIUS), "a long, b long").collect()
    label = list(range(len(fp)))
    for r in pairs:
        label[r.a] = min(label[r.a], r.b)
    assert label == simhash.tile_links(fp, simhash.RADIUS, tile=1 << 20).tolist()


def test_components_of_long_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(300, 340)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 5} | {i: 5 for i in range(300, 340)}


def run_lines(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n_lines string")
    return {r.doc_id: r for r in line_dedup.dedup_lines(df.repartition(3), **kw).collect()}


def test_lines_align_with_the_first_holder(spark):
    a = "\n".join(["alpha", "beta", "gamma", "", "delta"])
    rows = [(1, a), (2, "new one\nbeta\ngamma\n\nnew two"), (3, a), (4, None), (5, ""), (6, "solo"), (7, "delta\nbeta"), (8, "x\n" * 3 + "solo")]
    got = run_lines(spark, rows)
    assert got[1].text == a and got[1].n_removed == 0
    assert got[2].text == "new one\n\nnew two" and (got[2].n_lines, got[2].n_removed) == (5, 2)
    assert got[3].text == "" and got[3].n_removed == 4  # a whole copy keeps its blank line
    assert got[4].text is None and got[4].n_lines == 0
    assert (got[5].text, got[5].n_removed) == ("", 0) and got[6].n_removed == 0
    assert got[7].n_removed == 1  # delta and beta cross: one of them is in the longest common order
    assert got[8].text == "x\nx\nx"


def test_lines_of_a_large_group_are_found(spark):
    rows = [(i, f"own {i}\nshared one\nshared two\ntail {i}") for i in range(80)]
    got = run_lines(spark, rows)
    assert got[0].n_removed == 0 and all(got[i].text == f"own {i}\ntail {i}" for i in range(1, 80))


def test_lines_of_a_large_group_go_beside_a_rarer_line(spark):
    block = "shared one\nshared two\nshared three"
    rows = [(i, f"own {i}\n{block}\ntail {i}") for i in range(60)] + [(90, "first of two\nother"), (91, f"own 91\n{block}\nmiddle\nfirst of two")]
    got = run_lines(spark, rows)
    assert got[91].text == "own 91\nmiddle" and got[91].n_removed == 4


def test_lines_align_on_all_that_both_hold(spark):
    copy = "b1\nlicence\nb2\nfooter\nb3"
    rows = [(1, "footer\nmiddle\nlicence"), (2, copy), (3, "own\n" + copy)]
    got = run_lines(spark, rows)
    assert got[2].n_removed == 1  # licence and footer cross in the first document
    assert got[3].text == "own" and got[3].n_removed == 5


def test_lines_hold_repeated_and_null_ids(spark):
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (None, "a\nb"), (2, "a\nc")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == [(-1, "a\nb"), (1, "a\nb"), (1, "a\nb"), (2, "c")]
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_as_brute_force(spark):
    rng = random.Random(6)
    base = [[f"line {rng.randrange(60)}" for _ in range(rng.randrange(2, 12))] for _ in range(14)]
    rows = []
    for i in range(120):
        t = []
        for _ in range(rng.randrange(0, 4)):
            b = rng.choice(base)
            s = rng.randrange(len(b))
            t += b[s : s + rng.randrange(1, 9)] + [rng.choice(["", " \t", f"own {i}"])]
        rows.append((i * 2 + 1, "\n".join(t) if rng.random() > 0.05 else None))
    rows += [(r[0] + 1, r[1]) for r in rng.sample(rows, 15)]  # exact copies
    got = run_lines(spark, rows)
    want = brute.lines(rows, line_dedup.patience)
    assert {i: (r.text, r.n_removed) for i, r in got.items()} == want


def test_lines_keep_other_columns_as_they_are(spark):
    names = "_gone _copy _id _content _kept _n row gone copy doc n_removed".split()
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names) + ", `a.b` string"
    df = spark.createDataFrame([(1, "a\nb", *names, "dot"), (2, "b\nc", *names, "dot")], schema)
    got = line_dedup.dedup_lines(df).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["a\nb", "c"] and [r.n_removed for r in got] == [0, 1]
    for r in got:
        assert [r[n] for n in names if n != "n_removed"] == [n for n in names if n != "n_removed"] and r["a.b"] == "dot"


def test_patience_keeps_a_longest_common_order():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(1, 8)
        ys = rng.sample(range(n), n)
        best = max(sum(1 for _ in c) for k in range(n + 1) for c in combinations(range(n), k) if all(ys[a] < ys[b] for a, b in zip(c, c[1:])))
        # far apart, so that no block grows
        assert len(line_dedup.patience([([3 * i], [5 * y]) for i, y in enumerate(ys)])) == best


def test_lines_of_very_long_texts():
    n = 200_000
    began = time.perf_counter()
    assert len(line_dedup.patience([([i], [i]) for i in range(n)] + [(list(range(n, 2 * n)), list(range(n, 2 * n)))])) == 2 * n
    assert time.perf_counter() - began < 10


def test_patience_grows_blocks_over_repeated_lines():
    # lines of the later document 0..4 equal 10..14 of the first; lines 1 and 3 repeat in both
    shared = [([0], [10]), ([1, 3], [11, 13]), ([2], [12]), ([4], [14])]
    assert line_dedup.patience(shared) == [0, 1, 2, 3, 4]
    assert line_dedup.patience([([0], [5]), ([1], [4]), ([2], [6])]) in ([0, 2], [1, 2])


def test_full_batches_of_lines_are_worked_on_in_portions():
    import pyarrow as pa

    from tessera.llm.line_dedup import _delete, _lines

    texts = [f"{i}\n{'x' * 2_000}\n\n{i}" for i in range(10_000)]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array(texts), pa.array([str(i) for i in range(len(texts))])], names=["doc_id", "text", "content"])
    found = list(_lines([batch]))
    assert len(found) > 3 and max(x.num_rows for x in found) < 10_000
    rows = [r for x in found for r in x.to_pylist()]
    assert [r["doc_id"] for r in rows] == [i for i in range(len(texts)) for _ in range(2)] and rows[-2]["at"] == [0, 3]
    gone = pa.array([[[1]] if i % 2 else None for i in range(len(texts))], pa.list_(pa.list_(pa.int32())))
    left = list(_delete([pa.RecordBatch.from_arrays([ids, pa.array(texts), gone, pa.array([None] * len(texts), pa.bool_())], names=["row", "text", "gone", "copy"])]))
    assert len(left) > 3
    assert [t for x in left for t in x["text"].to_pylist()] == [f"{i}\n\n{i}" if i % 2 else t for i, t in enumerate(texts)]


def test_texts_are_not_carried_beside_what_replaces_them(spark):
    from tessera.llm import line_dedup

    docs = spark.createDataFrame([(1, "a\nb", "x"), (2, "c\na\nb", "y")], "doc_id long, text string, source string")
    kept = line_dedup.dedup_rows(docs)
    assert kept.schema["row"].dataType.names == ["doc_id", "source"]
    assert {r.doc_id: (r.text, r.n_removed, r.source) for r in line_dedup.dedup_lines(docs).collect()} == {1: ("a\nb", 0, "x"), 2: ("c", 2, "y")}
