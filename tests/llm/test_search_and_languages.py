from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import ann, language_id
from tessera.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, rank string"


def exact(x, ids, i, k=10):
    d = np.sqrt(((x - x[i]) ** 2).sum(1))
    d[ids == ids[i]] = np.inf
    return ids[np.lexsort((ids, d))[:k]]


def test_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6000, 16)).astype(np.float32)
    df = spark.createDataFrame([(int(i), v.tolist(), "r") for i, v in enumerate(x)], VECTORS)
    got = ann.nearest_neighbours(df, df.filter("vec_id % 100 = 0")).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.query_id, {})[r.rank] = r
    hits = 0
    for q in range(0, 6000, 100):
        rows = [by[q][i] for i in range(1, 11)]
        assert [(r.score, r.vec_id) for r in rows] == sorted((r.score, r.vec_id) for r in rows)
        for r in rows:
            assert abs(r.score - np.sqrt(((x[r.vec_id].astype(float) - x[q].astype(float)) ** 2).sum())) < 1e-12
        hits += len({r.vec_id for r in rows} & set(exact(x.astype(float), np.arange(6000), q).tolist()))
    assert hits / 600 >= 0.9


def recall(found, x, ids, queries, k=10):
    by: dict = {}
    for r in found:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(by[q] & set(exact(x, ids, list(ids).index(q), k).tolist())) for q in queries) / (k * len(queries))


def test_recall_of_the_registered_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").dropna().collect()
    rows = [r for r in rows if np.any(r.embedding) and np.isfinite(np.array(r.embedding, dtype=float)).all()]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    assert recall(QUERIES["op3_nearest_neighbours"](spark, sf_dir).collect(), x, ids, ids[ids % 100 == 0].tolist()) >= 0.9


def test_vectors_in_clusters_visit_few_leaves(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 24)) * 4
    x = centres[rng.integers(0, 60, 9000)] + rng.standard_normal((9000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = df.select("vec_id", F.col("embedding").alias("v"))
    placed, index = ann.build_index(rows, leaf=1000)
    sizes = {r["path"]: r["count"] for r in placed.groupBy("path").count().collect()}
    assert len(index) == 1 and sum(sizes.values()) == 9000 and len(sizes) > 20
    scanned = sum(sizes.get(r.path, 0) for r in ann.route_queries(rows.filter("vec_id % 100 = 0"), index, 10).collect()) / 90 / 9000
    assert scanned < 0.3
    got = ann.nearest_neighbours(df, df.filter("vec_id % 100 = 0"), leaf=1000).collect()
    assert recall(got, x, np.arange(9000), range(0, 9000, 100)) >= 0.9


def test_partitions_are_divided_again(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((100, 12)) * 5
    x = centres[rng.integers(0, 100, 8000)] + rng.standard_normal((8000, 12))
    x[:2500] = x[0]  # over a leaf, and not to be divided
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    placed, index = ann.build_index(df.select("vec_id", F.col("embedding").alias("v")), leaf=200)
    assert len(index) == 2 and placed.count() == 8000 and placed.select("path").distinct().count() > 32
    got = ann.nearest_neighbours(df, df.filter("vec_id % 100 = 0"), leaf=200).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(by[0]) == [(i, i) for i in range(1, 11)]
    assert recall(got, x, np.arange(8000), range(2500, 8000, 100)) >= 0.9


def test_vectors_of_other_lengths_and_huge_ones(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [1.0]), (3, [1.0, 2.0, 3.0]), (100, [3e200, 4e200]), (4, [1e-200, 0.0]), (200, [2e-200, 0.0])]
    df = spark.createDataFrame(rows, VECTORS.replace("float", "double").replace(", rank string", ""))
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest_neighbours(df, df.filter("vec_id % 100 = 0")).collect()}
    assert {b for _, b in got} == {0, 1, 4, 100, 200} and len(got) == 12
    assert got[0, 1] == 0.5 and all(math.isclose(got[pair], d, rel_tol=1e-14) for pair, d in (((100, 0), 5e200), ((0, 100), 5e200), ((200, 4), 1e-200)))


def test_search_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "r") for i, v in rows], VECTORS)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest_neighbours(df, df.filter("vec_id % 100 = 0")).collect())
    d = round(2**0.5, 9)
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 2, 0.0), (0, 4, 100, d), (100, 1, 0, d), (100, 2, 1, d), (100, 3, 2, d), (100, 4, 2, d)]
    assert ann.nearest_neighbours(df.limit(0), df).count() == 0
    assert ann.nearest_neighbours(df, df.limit(0)).count() == 0


def test_one_vector_for_a_third_of_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 8)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(int(i), v.tolist(), "r") for i, v in enumerate(x)], VECTORS)
    got = ann.nearest_neighbours(df, df.filter("vec_id in (0, 300)")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, i, 3 * i) for i in range(1, 11)] + [(300, i, 3 * (i - 1)) for i in range(1, 11)]


def test_held_out_accuracy(spark, sf_dir):
    found = QUERIES["op10_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    held = found.filter("held_out")
    assert held.count() > 10 and held.filter("lang_pred = lang").count() / held.count() >= 0.95
    assert found.filter("score < 0 or score > 1").count() == 0
    for r in found.select("doc_id", "held_out").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def model_of(*texts):
    counts = [np.bincount(language_id.trigrams(t), minlength=language_id.BUCKETS) + 1.0 for t in texts]
    return np.stack([c / c.sum() for c in counts])


def test_mixtures_and_languages_set():
    model = model_of("aaa bbb abab" * 50, "xxx yyy xyxy" * 50)
    langs, shares, _ = language_id.infer("aaa bbb abab " * 5, model)
    assert langs == [0] and shares == [1.0]
    langs, shares, _ = language_id.infer("aaa bbb abab " * 9 + "xxx yyy xyxy " * 3, model)
    assert langs == [0, 1] and 0.6 < shares[0] < 0.9 and abs(sum(shares) - 1) < 1e-9


def test_sets_of_more_than_three_languages():
    words = ["alpha beta", "jump over", "quick zig", "mint ford", "wind yard"]
    model = model_of(*[w * 400 for w in words])
    langs, shares, _ = language_id.infer(" ".join(words * 60), model)
    assert sorted(langs) == list(range(5)) and max(shares) < 0.3


def test_sets_as_brute_force():
    """Every set of languages, by EM in plain Python with many rounds: the best penalised likelihood, or very near it."""
    rng = random.Random(5)
    words = [[("".join(rng.choice(letters) for _ in range(4))) for _ in range(12)] for letters in ("abcde", "fghij", "cdfgk", "lmnop")]
    model = model_of(*[" ".join(rng.choice(ws) for _ in range(800)) for ws in words])
    for n in (1, 1, 2, 2, 3, 3, 4):
        text = " ".join(rng.choice(words[j]) for j in rng.sample(range(4), n) for _ in range(40))
        counts = Counter(language_id.trigrams(text).tolist())
        total = sum(counts.values())

        def em(langs):
            share = dict.fromkeys(langs, 1 / len(langs))
            for _ in range(400):
                new = dict.fromkeys(langs, 0.0)
                for t, c in counts.items():
                    whole = sum(share[j] * model[j, t] for j in langs)
                    for j in langs:
                        new[j] += c * share[j] * model[j, t] / whole / total
                share = new
            return sum(c * math.log(sum(share[j] * model[j, t] for j in langs)) for t, c in counts.items()), share

        best, langs, share = max((em(s)[0] - 0.5 * math.log(total) * k, s, em(s)[1]) for k in range(1, 5) for s in combinations(range(4), k))
        got, shares, _ = language_id.infer(text, model)
        assert tuple(sorted(got)) == langs and all(abs(share[j] - x) < 0.01 for j, x in zip(got, shares))


def test_more_labels_than_the_classifier_learns(spark):
    rows = [(i, f"text of label {i % 40} " * 3, f"l{i % 40:02d}") for i in range(200)] + [(1000 + i, "und der " * 9, "de") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify_languages(df, most=3).collect()
    assert len(got) == len(rows) and len({r.lang_pred for r in got}) <= 3 and all(r.lang_pred == "de" for r in got if r.doc_id >= 1000)


def test_identified_rows_come_back_as_they_are(spark):
    rows = [(i, w * 1500, lang, "keepme", "mine", "row") for i, (w, lang) in enumerate([("the and ", "en"), ("der und ", "de")] * 20)]
    rows += [(None, "the and the", "en", "keepme", "mine", "row"), (50, "1 2", "en", "keepme", "mine", "row"), (51, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, lang_pred string, row string")
    got = language_id.keep_identified(df)
    assert got.columns == df.columns and sorted(map(repr, got.collect())) == sorted(map(repr, df.filter("doc_id is null or doc_id < 50").collect()))
    noise = "".join(map(chr, np.random.default_rng(1).integers(0x4E00, 0x9000, 400)))
    assert language_id.keep_identified(df.union(spark.createDataFrame([(55, noise, None, "", "", "")], df.schema))).filter("doc_id = 55").count() == 0


def test_language_edge_cases(spark):
    rows = [(i, w * 30, lang, "p") for i, (w, lang) in enumerate([("the and ", "en"), ("der und ", "de")] * 20)]
    rows += [(100, None, "en", "p"), (101, "12 34 !", "en", "p"), (102, "", None, "p"), (None, "the and the", "en", "p"), (103, "und der " * 9, None, "p"), (103, "und der " * 9, None, "p"), (104, "der " * 30000, None, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language_id.identify_languages(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102))
    assert by[103].lang_pred == by[104].lang_pred == "de" and by[None].lang_pred == "en" and not by[None].held_out
    assert language_id.identify_languages(df.limit(0)).count() == 0
    unlabelled = language_id.identify_languages(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    assert all(r.langs == [] and r.shares == [] for r in (by[100], by[101], by[102])) and by[103].langs[0] == "de" and by[103].shares[0] == by[103].score


def test_identified_rows_reach_python_with_one_copy_of_the_text(spark):
    from tessera.llm import language_id

    texts = ["the cat sat on the mat and the dog sat too", "le chat est sur la table et le chien aussi", "1 2 3", None]
    docs = spark.createDataFrame([(i, t, ["en", "fr", None, None][i % 4], "s") for i, t in enumerate(texts * 10)], "doc_id long, Text string, lang string, source string")
    kept = language_id.keep_identified(docs)
    below = kept._jdf.queryExecution().analyzed().toString().split("MapInArrow", 1)[1]
    assert below.split("\n")[1].count("Text#") == 1
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {tuple(r) for r in docs.collect() if r.doc_id % 4 < 2}
