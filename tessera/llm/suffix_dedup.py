"""Operator 4, suffix-array deduplication of byte passages.

A byte goes if a window of ``LENGTH`` bytes that covers it also starts earlier, by document
id, then place. The suffix array holds only suffixes that can matter: those at the anchors
of contested blocks (see ``anchors``), and, read backwards, the prefixes before them.

They are ordered by deep-shallow sorting: a multikey quicksort over 8-byte keys to a shallow
depth, then, in the groups that still agree, a blind trie. Common prefixes of neighbours in
the two orders then give, for each offset of a window to its anchor, the windows that are
equal, and the earliest of them stays.

Two kinds of windows don't go through the sort: those of a block whose content occurs earlier
as a whole are settled when blocks meet, and those at an anchor with over ``GROUP`` contested
blocks are grouped by a 128-bit digest of their bytes, which splits such a group among tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import CONTESTED, COPY, byte_units, find_blocks
from .common import bytes_of, of_one_text, written

LENGTH = 100
GRAM = 16
SHALLOW = 4  # keys of 8 bytes
#: An anchor with more contested blocks than this is settled by grouping its windows, not in one task.
GROUP = 50_000
_BATCH = 200_000


def _keys(texts: np.ndarray, width: int) -> np.ndarray:
    """Fixed-width byte strings (shorter ones are padded with zeros) as big-endian 8-byte keys."""
    return texts.view(">u8").reshape(len(texts), width // 8).astype(np.uint64)


def multikey_quicksort(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by the first ``depth`` keys, start of each group of equals): ternary splits, all open groups at a time.

    Each round splits every open group by its middle member's key into less, equal and more;
    an equal part goes on with the next key, the others with the same one.
    """
    n = len(keys)
    order, group, level = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    starts = np.zeros(1, dtype=np.int64)
    while True:
        sizes = np.diff(np.append(starts, n))
        open_ = (sizes > 1) & (level[starts] < depth)
        if not open_.any():
            return order, starts
        at = np.flatnonzero(np.repeat(open_, sizes))
        pivots = np.repeat(keys[order[starts + sizes // 2], np.minimum(level[starts], depth - 1)], sizes)[at]
        mine = keys[order[at], level[at]]
        side = np.where(mine < pivots, 0, np.where(mine == pivots, 1, 2))
        place = group[at] * 3 + side
        moved = np.argsort(place, kind="stable")
        order[at], side, place = order[at][moved], side[moved], place[moved]
        level[at] = level[at][moved] + (side == 1)
        group = group * 3 + 1
        group[at] = place
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


class BlindTrie:
    """Orders strings by inserting them one by one into a trie that stores branching depths and bytes only."""

    def __init__(self) -> None:
        self.root = None  # [depth, {byte: child}] or the number of a string

    def insert(self, i: int, texts: list[bytes]) -> None:
        if self.root is None:
            self.root = [None, i]
            return
        text, node = texts[i], self.root
        while node[0] is not None and len(text) > node[0] and text[node[0]] in node[1]:  # blindly down
            node = node[1][text[node[0]]]
        while node[0] is not None:
            node = next(iter(node[1].values()))
        other = texts[node[1] if isinstance(node[1], int) else node[1][0]]
        most, depth = min(len(text), len(other)), 0
        while depth < most and text[depth : depth + 8] == other[depth : depth + 8]:
            depth += 8
        depth = min(depth, most)
        while depth < most and text[depth] == other[depth]:
            depth += 1
        node = self.root
        while node[0] is not None and node[0] < depth:
            node = node[1][text[node[0]]]
        if node[0] == depth:
            node[1][text[depth]] = [None, i]
        elif depth == len(text) == len(other):  # equal strings share a leaf
            node[1] = [*([node[1]] if isinstance(node[1], int) else node[1]), i]
        else:
            below = [node[0], node[1]]
            node[0], node[1] = depth, {other[depth]: below, text[depth]: [None, i]}

    def ordered(self) -> list[tuple[int, int]]:
        """(string, length of the prefix it shares with the one before), in order; -1 marks an equal string."""
        found: list[tuple[int, int]] = []
        stack = [(self.root, 0)]
        while stack:
            (depth, kids), shared = stack.pop()
            if depth is None:
                leaf = [kids] if isinstance(kids, int) else kids
                found += [(leaf[0], shared), *((x, -1) for x in leaf[1:])]
            else:
                order = sorted(kids)
                stack += [(kids[b], depth) for b in order[:0:-1]]
                stack.append((kids[order[0]], shared))
        return found


def deep_shallow_sort(texts: np.ndarray, keys: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows of a byte matrix, bytes shared with the row before; 0 for the first).

    Strings of one multikey group agree in 8 * depth bytes; a pair is compared at once, a
    larger group goes through a blind trie.
    """
    n, width = texts.shape
    order, starts = multikey_quicksort(keys, min(depth, keys.shape[1]))
    shared = np.zeros(n, dtype=np.int64)
    sizes = np.diff(np.append(starts, n))
    for s, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        members = order[s : s + size]
        strings, trie = [texts[m].tobytes() for m in members], BlindTrie()
        for i in range(size):
            trie.insert(i, strings)
        ranked = trie.ordered()
        order[s : s + size] = members[[i for i, _ in ranked]]
        shared[s : s + size] = [width if x < 0 else x for _, x in ranked]
    pairs = starts[sizes == 2]
    differ = texts[order[pairs]] != texts[order[pairs + 1]]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    swap = (first < width) & (texts[order[pairs], np.minimum(first, width - 1)] > texts[order[pairs + 1], np.minimum(first, width - 1)])
    order[pairs[swap]], order[pairs[swap] + 1] = order[pairs[swap] + 1], order[pairs[swap]]
    shared[pairs + 1] = first
    heads = starts[1:]
    if len(heads):
        differ = texts[order[heads]] != texts[order[heads - 1]]
        shared[heads] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, shared


def earlier_windows(after: np.ndarray, before: np.ndarray, anchor: np.ndarray, rank: np.ndarray, least: np.ndarray, most: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(block, offset) of each window that a block of lower rank has too.

    after: the bytes from each block's anchor on; before: those before it, read backwards;
    anchor: blocks of different anchors hold no equal window; least, most: the block's window
    offsets, counted from the window's start to the anchor. rank: order of the blocks.
    """
    by_after, same_after = deep_shallow_sort(after, _keys(after, after.shape[1]))
    by_before, same_before = deep_shallow_sort(before, _keys(before, before.shape[1]))
    n = len(anchor)
    blocks, offsets = [], []
    rank_after, rank_before = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(least.min(initial=length)), int(most.max(initial=-1)) + 1):
        has = (least <= o) & (o <= most)
        if has.sum() < 2:
            continue
        rank_after[by_after] = np.cumsum(same_after < length - o)
        rank_before[by_before] = np.cumsum(same_before < o)
        at = np.flatnonzero(has)
        order = at[np.lexsort((rank[at], rank_before[at], rank_after[at], anchor[at]))]
        later = (anchor[order[1:]] == anchor[order[:-1]]) & (rank_after[order[1:]] == rank_after[order[:-1]]) & (rank_before[order[1:]] == rank_before[order[:-1]])
        blocks.append(order[1:][later])
        offsets.append(np.full(later.sum(), o))
    return (np.concatenate(blocks), np.concatenate(offsets)) if blocks else (np.zeros(0, np.int64), np.zeros(0, np.int64))


CUT = "anchor bigint, doc_id bigint, at int, least int, most int, before binary, after binary"
SPAN = "doc_id bigint, start int, stop int"


def _cut_out(length: int):
    """doc_id, text, blocks to CUT rows: the bytes around each block's anchor that its windows reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, blocks in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), batch.column(2).to_pylist()):
                for b in blocks:
                    at = b["start"] + b["offset"]
                    most, least = b["offset"], b["offset"] - b["windows"] + 1
                    rows.append((b["anchor"], doc, at, least, most, text[b["start"] : at][::-1], text[at : at + length - least]))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in CUT.split(", ")])

    return run


def _settle(length: int):
    """CUT rows, an anchor's rows together, to spans of windows that occur earlier."""
    wide = -(-length // 8) * 8

    def padded(column: pa.Array) -> np.ndarray:
        texts = column.to_pylist()
        return np.frombuffer(b"".join(t.ljust(wide, b"\0") for t in texts), dtype=np.uint8).reshape(len(texts), wide)

    def spans(table: pa.Table) -> pa.RecordBatch:
        t = {name: table.column(name).combine_chunks() for name in table.column_names}
        num = {k: t[k].to_numpy() for k in ("anchor", "doc_id", "at", "least", "most")}
        order = np.lexsort((num["at"], num["doc_id"]))
        again = np.concatenate(([False], (num["doc_id"][order[1:]] == num["doc_id"][order[:-1]]) & (num["at"][order[1:]] == num["at"][order[:-1]])))
        if again.any():  # rows that repeat an id are one document
            return spans(table.take(pa.array(np.sort(order[~again]))))
        rank = np.empty(len(table), np.int64)
        rank[np.lexsort((num["at"], num["doc_id"]))] = np.arange(len(table))
        block, offset = earlier_windows(padded(t["after"]), padded(t["before"]), num["anchor"], rank, num["least"].astype(np.int64), num["most"].astype(np.int64), length)
        order = np.lexsort((-offset, block))
        block, offset = block[order], offset[order]
        first = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (offset[1:] != offset[:-1] - 1)))) if len(block) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(block)) - 1
        start, end = num["at"][block[first]] - offset[first], num["at"][block[last]] - offset[last] + length
        return pa.RecordBatch.from_arrays([pa.array(num["doc_id"][block[first]]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc_id", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= _BATCH:
                table = pa.Table.from_batches(held)
                anchors = table.column("anchor").to_numpy()
                whole = int(np.searchsorted(anchors, anchors[-1]))  # rows come in order of anchor
                if whole:
                    yield spans(table.slice(0, whole))
                    held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield spans(pa.Table.from_batches(held))

    return run


def _windows(length: int):
    """CUT rows to one row a window: its digest (two halves) and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, doc, at = [], [], [], []
            for d, p, least, most, before, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "least", "most", "before", "after"))):
                text = before[::-1] + after
                for o in range(least, most + 1):
                    h = xxhash.xxh3_128_intdigest(text[most - o : most - o + length])
                    a.append((h >> 64) - (1 << 63))
                    b.append((h & (1 << 64) - 1) - (1 << 63))
                    doc.append(d)
                    at.append(p - o)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int32())], names=["w1", "w2", "doc_id", "start"])

    return run


def remove_spans(docs: DataFrame, spans: DataFrame, finish, schema: str) -> DataFrame:
    """docs (doc_id, text) with each document's spans, through ``finish`` (an Arrow map)."""
    mine = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return docs.join(mine, "doc_id", "left").mapInArrow(finish, schema)


def merged(spans) -> list[tuple[int, int]]:
    """Spans joined where they overlap or touch, in order."""
    found: list[list[int]] = []
    for s in sorted((x["start"], x["stop"]) for x in spans or ()):
        if found and s[0] <= found[-1][1]:
            found[-1][1] = max(found[-1][1], s[1])
        else:
            found.append(list(s))
    return [(a, b) for a, b in found]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(bytes_of(batch.column("text")), batch.column("spans").to_pylist()):
            gone, kept, end = merged(spans), [], 0
            for a, b in gone:
                kept.append(text[end:a])
                end = b
            kept.append(text[end:])
            kept = b"".join(kept)
            rows.append((len(text), len(text) - len(kept), len(gone), kept))
        n, removed, spans, kept = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _finish(batches):
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([hashlib.sha256(k).hexdigest() for k in batch.column(4).to_pylist()], pa.string())], names=[*batch.schema.names[:4], "kept_sha256"])


KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, start, stop: spans of bytes, overlapping or not, that earlier passages cover. docs: doc_id (not null), text."""
    found = find_blocks(docs, byte_units, length, gram, keep_first=True)
    found = written(found.select("doc_id", "kind", "start", "windows", F.when(F.col("kind") == CONTESTED, F.col("offset")).alias("offset"), F.when(F.col("kind") == CONTESTED, F.col("anchor")).alias("anchor")))
    copies = found.filter(F.col("kind") == COPY).select("doc_id", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("stop"))
    contested = found.filter(F.col("kind") == CONTESTED)
    large = contested.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group).select("anchor", F.lit(True).alias("large"))
    has_large = not large.isEmpty()
    if has_large:
        contested = contested.join(large, "anchor", "left")

    def around(rows: DataFrame) -> DataFrame:
        per_doc = rows.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "offset", "anchor")).alias("blocks"))
        return docs.join(per_doc, "doc_id").mapInArrow(_cut_out(length), CUT)

    few = contested.filter("large is null") if has_large else contested
    spans = around(few).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_settle(length), SPAN)
    if has_large:
        windows = around(contested.filter("large")).mapInArrow(_windows(length), "w1 bigint, w2 bigint, doc_id bigint, start int")
        first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        later = windows.join(first, ["w1", "w2"]).filter(F.struct("doc_id", "start") != F.col("first"))
        spans = spans.union(later.select("doc_id", "start", (F.col("start") + length).alias("stop")))
    return copies.union(spans)


def dedup_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans and kept (or kept_sha256).

    * null text: empty. Texts shorter than ``length`` bytes keep everything.
    * null doc_id: the row keeps everything and gives no passage to others.
    * rows that repeat an id and its text count as one document and each gets its result; an id that
      stands with different texts names no document, and its rows are treated as those without an id.
    * no rows: no rows. Other columns of the input are not read.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    known, unknown = of_one_text(rows)
    finish, schema = (_digested, DIGEST) if digest else (_finish, KEPT)
    none = unknown.withColumn("spans", F.lit(None).cast("array<struct<start:int,stop:int>>")).mapInArrow(finish, schema)
    return remove_spans(known, repeated_spans(known, length), finish, schema).union(none)


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS k
        FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200) x),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM win) y WHERE n > 1),
runs AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS fresh FROM later),
numbered AS (SELECT doc_id, p, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM runs),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, run),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
           UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(length(h)) // 2 FROM d LEFT JOIN spans ON spans.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (SELECT pieces.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS h, sum(b - a) AS n FROM pieces JOIN d ON d.doc_id = pieces.doc_id GROUP BY pieces.doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(length(d.h) // 2 - n AS BIGINT) AS n_removed,
       (SELECT count(*) FROM spans WHERE spans.doc_id = d.doc_id) AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id
"""
