from __future__ import annotations

import brute
import pytest

from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.mixing import MAX_EPOCHS, WEIGHTS, mix_sources
from tessera.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, source string, keep_id string, taken string"
ROWS = [
    (5, "a b", "x", None, None), (3, "ab", "x", None, None), (4, "a\tb", None, None, None), (9, None, "y", None, None), (8, "", "y", None, None),
    (7, " \n\x0b", "y", None, None), (1, "ab ", "", None, None), (2, "é " * 4000, "z", None, None), (6, "é" * 4000, "z", None, None), (10, "ab", "x", None, None),
]


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_mix_sources"])
def test_same_rows_as_sql(spark, sf_dir, name):
    from oracle import connect, same_rows

    same_rows(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


def test_exact_dedup_edge_cases(spark):
    got = {tuple(r) for r in exact_dedup(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()}
    assert got == brute.exact_dedup([r[:2] for r in ROWS])


def test_exact_dedup_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a "), (None, "b")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup(rows).collect())
    assert got == [(-1, -1, 1, True), (-1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    assert exact_dedup(rows.limit(0)).count() == 0


def test_mix_reaches_its_targets(spark):
    rows = [(i, "w " * (i % 7), f"s{min(i % 9, 4)}" if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df, rows_per_range=100).collect()
    sources = {i: s for i, _, s in rows}
    total = sum(r["size"] for r in got)
    taken, target, size = {}, {}, {}
    for r in got:
        s = sources[r.doc_id]
        assert r["size"] == r.doc_id % 7 and r.taken in {0, r["size"], MAX_EPOCHS * r["size"]}
        taken[s] = taken.get(s, 0) + r.taken
        target[s], size[s] = r.target, r.source_size
    order = sorted(target, key=lambda s: (s is None, s or ""))
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 and all(target[s] <= 2 * size[s] for s in order)
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    free = [target[s] / weight[s] for s in order if target[s] < 2 * size[s] - 1e-9]
    assert max(free) - min(free) < 1e-6  # unsaturated sources share by weight
    assert all(abs(taken[s] - target[s]) <= 24 for s in order)
    assert sum(taken.values()) <= 1.5 * total
    again = mix_sources(df.repartition(7), rows_per_range=100).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_mix_edge_cases(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert mix_sources(df).count() == len(ROWS)
    assert mix_sources(df.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, " ", "a"), (2, " ", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mix_sources(empty).collect()] == [0, 0, 0]
