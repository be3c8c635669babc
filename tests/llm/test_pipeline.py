"""The pipeline's stages, each on what its predecessor kept, against brute force on a small table."""

from __future__ import annotations

import os

import brute
import pytest
from test_near_sets import components, sets

import corpus_pipeline
from tessera.llm.pieces import MODEL

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    en = [f"the {w} and then {w} went home {i} times" for i, w in enumerate(["cat", "dog", "bird", "fish", "horse", "mouse", "goat", "duck"] * 4)]
    de = [f"der {w} und dann ging {w} nach hause {i} mal" for i, w in enumerate(["hund", "katze", "vogel", "fisch"] * 4)]
    docs = [(i, t, "en", "a") for i, t in enumerate(en)] + [(100 + i, t, "de", "b") for i, t in enumerate(de)]
    docs += [(200, en[0], "en", "a"), (201, "own line of text here\n" + en[1], "en", "c"), (202, None, "en", "a"), (203, "12 34", None, None), (204, en[5] + " now", "en", "a")]
    return [(*d, len(d[1] or "")) for d in docs]


@pytest.mark.skipif(not os.path.exists(MODEL), reason="the vocabulary file is not here")
def test_stages(spark, tmp_path):
    df = spark.createDataFrame(rows(), COLUMNS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash", "mix_sources", "sentencepiece"]
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
        kept.append(docs.collect())
        if name != "sentencepiece":
            assert docs.columns == df.columns
    languages, lines, near, mixed, encoded = kept
    assert {r.doc_id for r in languages} == {r[0] for r in rows()} - {202, 203}
    seen, want = set(), {}
    for r in sorted(languages, key=lambda r: r.doc_id):  # single-line documents: a later equal line goes
        left = [x for x in r.text.split("\n") if x not in seen]
        seen |= set(r.text.split("\n"))
        if left:
            want[r.doc_id] = "\n".join(left)
    assert {r.doc_id: r.text for r in lines} == want and all(r.n_chars == len(r.text) for r in lines)
    ids = sorted(want)
    groups = components(sets([want[i] for i in ids]))
    assert {r.doc_id for r in near} == {ids[c] for c in groups}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and len(mixed) <= 2 * len(near)
    size = sum(len(brute.words(r.text)) for r in near)
    longest = max(len(brute.words(r.text)) for r in near)
    assert 1.5 * size - longest <= sum(len(brute.words(r.text)) for r in mixed) <= 1.5 * size
    assert {r.doc_id for r in encoded} == {r.doc_id for r in mixed} and max(r["sample"] for r in encoded) == 2
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, encoded))


EXTRA = "row string, n_lines string, _gone string, score string, lang_pred string, key string, times string, size string"


def hard_rows():
    """Null and repeated ids, repeated rows, null, empty and long texts, and columns that clash with internal names."""
    text = [f"the cat {i} and the dog {i} went home for dinner again on day {i * 7} of the year\nline {i}" for i in range(30)]
    found = [(i, t, "en", "abc"[i % 3]) for i, t in enumerate(text)]
    found += [(None, "no id for this text about cats", "en", "a")] * 2 + [(None, "another text that has no id at all", "en", None)]
    found += [(5, text[5], "en", "c")] * 3 + [(6, "id six again with another text", "en", "a"), (70, None, "en", "a"), (71, "", None, "b"), (72, "word " * 20_000, "en", "b")]
    return [(*d, len(d[1] or ""), *(f"{c}{i}" for c in "stuvwxyz")) for i, d in enumerate(found)]


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "simhash", "mix_sources"])
def test_stages_on_hard_rows(spark, name):
    df = spark.createDataFrame(hard_rows(), f"{COLUMNS}, {EXTRA}")
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, df.repartition(3), "")
    assert got.columns == df.columns
    out = got.collect()
    before = {tuple(r)[5:]: r for r in df.collect()}
    for r in out:
        was = before[tuple(r)[5:]]  # the extra columns name the row and are as they were
        assert (r.doc_id, r.lang, r.source) == (was.doc_id, was.lang, was.source)
        assert name == "line_dedup" or r.text == was.text
    assert stage(spark, df.limit(0), "").count() == 0
    ids = [r.doc_id for r in out]
    if name == "language_id":
        assert len(out) == len(before) - 2 and {70, 71}.isdisjoint(ids)
    if name == "line_dedup":
        assert ids.count(None) == 3 and {70, 71} <= set(ids)
    if name == "simhash":
        assert ids.count(None) == 2 and ids.count(5) == 1 and ids.count(6) == 2 and {70, 71} & set(ids) == {70}
    if name == "mix_sources":
        size = lambda rows: sum(len(brute.words(r.text)) for r in rows)
        assert None in ids and abs(size(out) - 1.5 * size(before.values())) <= 20_000


def test_mixed_rows_as_the_mix_says(spark):
    from collections import Counter

    from tessera.llm import mixing

    rows = [(i % 150 if i % 11 else None, f"w{i % 9} " * (i % 7), f"s{min(i % 9, 4)}" if i % 13 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    said = Counter()
    for r in mixing.mix_sources(df, rows_per_range=50).collect():
        if r.taken:
            said[r.doc_id, r["size"]] += r.taken
    did = Counter()
    for r in mixing.mixed_rows(df, rows_per_range=50).collect():
        did[r.doc_id, len(brute.words(r.text))] += len(brute.words(r.text))
    assert did == said and sum(did.values()) > 1000
