"""Operator 9, substring deduplication by compaction of a De Bruijn graph.

The graph's edges are token k-mers, k being ``LENGTH`` words; nodes are the k - 1 words that
neighbouring k-mers share. Runs of k-mers with one minimizer (``anchors``) are taken as one
edge, so the graph has about one edge for each 16 words, and single k-mers are edges only
where equal minimizers stand in unequal surroundings.

1. Candidate edges come from the blocks. 2. Source coordinates verify them: the words at
(document, first word, k-mers) are read again and edges are equal only if their text is.
3. An edge is linked to the next one if in every place one follows the other, that is, if
the node between them does not branch among repeated edges. 4. Nonbranching paths compact
by joins: a path lies whole at the first occurrence of its edges, so it is an island of
linked edges there, however long. 5. Each further occurrence of a stretch of a path is one
long repeated span. Every copy of a repeated window goes, the first one too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import BLOCKS, CONTESTED, COPY, find_blocks, meet, met_here, word_units
from .common import bytes_of, of_one_text, written
from .suffix_dedup import merged, remove_spans

LENGTH = 35
GRAM = 5
_EDGE, _KMER, _PARTNER = 0, 1, 2  # of a verified piece: graph edge, single k-mer, k-mer of a block that is an edge itself


def _read_again(length: int):
    """doc_id, text, blocks to BLOCKS rows keyed by the 128-bit digest of the words at each edge's coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            lists = batch.column(2)
            inner, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            first, windows, kind, whole = (inner.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "windows", "kind", "whole"))
            single = kind == CONTESTED
            times = np.where(single, np.where((whole == 1) & (windows == 1), 0, windows), 1)  # a single k-mer that is an edge itself is read as that
            row = np.repeat(np.arange(len(first)), times)
            start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            n = np.where(single, 1, windows)[row]
            role = np.where(single, np.where(whole == 1, _PARTNER, _KMER), _EDGE)[row]
            pieces = np.concatenate(([0], np.cumsum(times)))[ends]
            keys: list[bytes] = []
            for i, text in enumerate(bytes_of(batch.column(1))):
                a, b = pieces[i], pieces[i + 1]
                words = text.split()
                joined = b" ".join(words)
                upto = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
                last = np.minimum(start[a:b] + n[a:b] + length - 1, len(words))
                keys += [digest(joined[x:y]) for x, y in zip(upto[np.minimum(start[a:b], len(words))].tolist(), (upto[last] - 1).tolist())]
            if not keys:
                continue
            halves = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
            doc = np.repeat(batch.column(0).to_numpy(), np.diff(pieces))
            yield met_here(doc, np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), start, n, role, np.zeros(len(doc), bool), keep_first=False)

    return run


def repeated_edges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, start, windows, edge, role: every occurrence of a graph edge that occurs again. docs: doc_id (not null), text."""
    found = written(find_blocks(docs, word_units, length, gram, keep_first=False).select("doc_id", "kind", "start", "windows", "whole"))
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "kind", F.col("whole").cast("int").alias("whole"))).alias("blocks"))
    read = docs.join(per_doc, "doc_id").mapInArrow(_read_again(length), BLOCKS)
    met = meet(read, keep_first=False).filter((F.col("kind") == COPY) & (F.col("offset") != _PARTNER))
    return written(met.select("doc_id", "start", "windows", F.xxhash64("anchor", "content").alias("edge"), F.col("offset").alias("role")))


def compacted_spans(edges: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, start, stop, source_doc, source_start: stretches of nonbranching paths, with the path's place at its first occurrence."""
    at = Window.partitionBy("doc_id").orderBy("start")
    end = F.col("start") + F.col("windows")
    steps = edges.filter(F.col("role") == _EDGE).select("doc_id", "start", "windows", "edge")
    steps = steps.withColumn("after", F.when(F.lead("start").over(at) == end, F.lead("edge").over(at)))
    steps = steps.withColumn("before", F.when(F.lag(end).over(at) == F.col("start"), F.lag("edge").over(at)))
    once = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    nodes = steps.groupBy("edge").agg(once("after"), once("before"), F.min(F.struct("doc_id", "start")).alias("first"))
    ahead = nodes.select(F.col("edge").alias("before"), F.col("after").alias("edge"), F.lit(True).alias("linked")).dropna()
    linked = nodes.select("edge", "before", "first.*").join(ahead, ["edge", "before"], "left")
    path = F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(at)
    paths = linked.withColumn("path", path).withColumn("step", F.row_number().over(at))
    paths = paths.withColumn("source_start", F.min("start").over(Window.partitionBy("doc_id", "path"))).select("edge", F.col("doc_id").alias("source_doc"), "source_start", "step")

    placed = edges.filter(F.col("role") == _EDGE).select("doc_id", "start", "windows", "edge").join(paths, "edge")
    goes_on = (F.lag(end).over(at) == F.col("start")) & (F.lag("source_doc").over(at) == F.col("source_doc")) & (F.lag("source_start").over(at) == F.col("source_start")) & (F.lag("step").over(at) == F.col("step") - 1)
    runs = placed.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(at))
    return runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), (F.max(end) + (length - 1)).alias("stop"), F.first("source_doc").alias("source_doc"), F.first("source_start").alias("source_start")).drop("run")


def _finish(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, out = [], [], []
            for text, spans in zip(bytes_of(batch.column("text")), batch.column("spans").to_pylist()):
                words, kept, end = text.split(), [], 0
                for a, b in merged(spans):
                    kept += words[end:a]
                    end = b
                kept += words[end:]
                n.append(len(words))
                removed.append(len(words) - len(kept))
                joined = b" ".join(kept)
                out.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"])

    return run


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed and kept words, joined by one space (or kept_sha256).

    A word goes if a window of ``length`` words that covers it also starts anywhere else.

    * null text: no words. Texts of fewer words than ``length`` keep all.
    * null doc_id: the row keeps all its words and gives no passage to others.
    * rows that repeat an id and its text count as one document and each gets its result; an id that
      stands with different texts names no document, and its rows are treated as those without an id.
    * no rows: no rows. Other columns of the input are not read.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    known, unknown = of_one_text(rows)
    edges = repeated_edges(known, length)
    spans = compacted_spans(edges, length).select("doc_id", "start", "stop")
    spans = spans.union(edges.filter(F.col("role") == _KMER).select("doc_id", "start", (F.col("start") + length).alias("stop")))
    schema = f"doc_id bigint, n_words bigint, n_removed bigint, {'kept_sha256' if digest else 'kept'} string"
    none = unknown.withColumn("spans", F.lit(None).cast("array<struct<start:int,stop:int>>")).mapInArrow(_finish(digest), schema)
    return remove_spans(known, spans, _finish(digest), schema).union(none)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35) x),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM win JOIN twice USING (k)) y),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w WHERE len(ws) > 0),
kept AS (SELECT words.doc_id, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY words.j) FILTER (WHERE gone.j IS NULL) AS text
         FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
