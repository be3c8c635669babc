"""Minimizer blocks: the candidates of the operators that look for long repeated passages.

Every window of ``length`` units (bytes, or words as hashes) picks as its anchor the unit
sequence of ``gram`` units inside it with the least hash, leftmost on ties. Equal windows
pick equal anchors at equal offsets, so equal windows meet when blocks meet by anchor. A
block is a run of windows of one document with one anchor: about one for each
(length - gram + 2) / 2 units, which is all that is shuffled; the text is not.

A block whose whole content occurs before needs no look at the text (``COPY``); two contents
are taken for equal if 128 bits are, 64 of the anchor and 64 of all its bytes. A block whose
anchor also occurs with other content does (``CONTESTED``). All others hold no
repeated window and go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, checkpointed

COPY, CONTESTED = 0, 1
#: Blocks are counted by slot, the last 16 bits of their anchor. Those of a slot with this many, and
#: OVER times the mean slot at least, are dealt out by content.
HEAVY = 2_000
OVER = 4
_SLOTS = 1 << 16
_CHUNK = 1 << 22
#: A unit's place in its stretch fits 32 bits: a string column holds less than 2^31 bytes a value.
_PLACE = np.uint64((1 << 32) - 1)
BLOCKS = "doc_id bigint, anchor bigint, content bigint, place bigint, local boolean"
FOUND = "doc_id bigint, kind int, start int, windows int, offset int, anchor bigint, content bigint, whole boolean"


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


class Units:
    """A stretch of documents as unit hashes, with the bytes that identify a run of units."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, raw: memoryview, width: int) -> None:
        self.hashes, self.lengths, self.raw, self.width = hashes, lengths, raw, width
        self.offsets = np.cumsum(lengths) - lengths


def byte_units(texts: list[bytes]) -> Units:
    raw = b"".join(texts)
    return Units(_BYTES[np.frombuffer(raw, dtype=np.uint8)], np.fromiter(map(len, texts), np.int64, len(texts)), memoryview(raw), 1)


def word_hash(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    found = [known.get(w) or known.setdefault(w, digest(w)) for w in words]
    return np.array(found, dtype=np.uint64)


def word_units(texts: list[bytes]) -> Units:
    """Words end at the six ASCII white spaces, which is where bytes.split() cuts."""
    words = [t.split() for t in texts]
    hashes = word_hash([w for ws in words for w in ws], {})
    return Units(hashes, np.fromiter(map(len, words), np.int64, len(words)), memoryview(hashes).cast("B") if len(hashes) else memoryview(b""), 8)


def _grams(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive units, by doubling."""
    grown, size, got, have = x, 1, None, 0
    step = np.uint64(0x9E3779B97F4A7C15)
    while True:
        if k & size:
            if got is None:
                got, have = grown, size
            else:
                n = len(x) - have - size + 1
                got, have = mix(got[:n] * step + grown[have : have + n]), have + size
        size *= 2
        if size > k:
            return got
        n = len(x) - size + 1
        grown = mix(grown[:n] * step + grown[size // 2 : size // 2 + n])


def blocks(units: Units, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, the anchor's offset from the first window, anchor) of each block; places in the stretch.

    Grams are ordered by the first 32 bits of their hash, then from left to right, in every
    stretch alike, so what a window picks doesn't depend on the text around it.
    """
    x = units.hashes
    none = np.zeros(0, dtype=np.int64)
    windows = np.maximum(units.lengths - length + 1, 0)
    if not windows.any():
        return none, none, none, none, none.astype(np.uint64)
    gram_hash = _grams(x, gram)
    least = (gram_hash & ~_PLACE) | np.arange(len(gram_hash), dtype=np.uint64)
    size, span = 1, length - gram + 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    doc = np.repeat(np.arange(len(windows)), windows)
    at = np.repeat(units.offsets - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    anchor = (least[at] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.append(first, len(at)))
    return doc[first], at[first], count, anchor[first] - at[first], gram_hash[anchor[first]]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), bytes_of(batch.column(1))
        start, held = 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > _CHUNK:
                yield ids[start:i], texts[start:i]
                start, held = i, 0
            held += len(t)
        if start < len(texts):
            yield ids[start:], texts[start:]


def _slot(anchor: np.ndarray) -> np.ndarray:
    return (anchor.view(np.uint64) & np.uint64(_SLOTS - 1)).astype(np.int64)


def heavy_slots(docs: DataFrame, units: Callable, length: int, gram: int) -> np.ndarray:
    """For each slot, whether its blocks are so many that one task should not hold them. docs: doc_id, text.

    Every block of every stretch counts, however rare its anchor is in the stretch. The counts
    decide only how blocks are dealt; a slot that is heavy by chance costs some work.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(_SLOTS, dtype=np.int64)
        for _, texts in _stretches(batches):
            n += np.bincount(_slot(blocks(units(texts), length, gram)[4]), minlength=_SLOTS)
        slots = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(n[slots])], names=["slot", "n"])

    counts = checkpointed(docs.mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")))
    least = max(HEAVY, OVER * (counts.agg(F.sum("n")).first()[0] or 0) // _SLOTS)
    heavy = np.zeros(_SLOTS, dtype=bool)
    heavy[[r["slot"] for r in counts.filter(F.col("n") >= least).select("slot").collect()]] = True
    return heavy


def find_blocks(docs: DataFrame, units: Callable, length: int, gram: int, keep_first: bool) -> DataFrame:
    """FOUND rows: COPY blocks (every window occurs elsewhere) and CONTESTED ones. docs: doc_id (not null), text.

    keep_first: the first block of equal ones, by document and place, is no copy; otherwise it
    is one too. A contested block that is a copy as well has ``whole`` set. Rows that repeat
    an id and its text count once. A task settles the copies within a stretch itself, so a
    passage that a third of all documents hold leaves each stretch as one row to be met.
    """
    heavy = heavy_slots(docs, units, length, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for ids, texts in _stretches(batches):
            u = units(texts)
            doc, start, n, offset, anchor = blocks(u, length, gram)
            if not len(doc):
                continue
            w, raw = u.width, u.raw
            content = np.array([digest(raw[a:b]) for a, b in zip((start * w).tolist(), ((start + n + length - 1) * w).tolist())], dtype=np.uint64)
            start, doc = start - u.offsets[doc], ids[doc]
            yield met_here(doc, anchor.view(np.int64), content.view(np.int64), start, n, offset, heavy[_slot(anchor)], keep_first)

    rows = docs.mapInArrow(cut, BLOCKS)
    return meet(rows, keep_first)


def met_here(doc: np.ndarray, anchor: np.ndarray, content: np.ndarray, start: np.ndarray, n: np.ndarray, offset: np.ndarray, heavy: np.ndarray, keep_first: bool) -> pa.RecordBatch:
    """BLOCKS rows: of equal blocks in one stretch, all but the first are settled as local copies."""
    order = np.lexsort((start, doc, content, anchor))
    a, c, i, s = anchor[order], content[order], doc[order], start[order]
    same = np.concatenate(([False], (a[1:] == a[:-1]) & (c[1:] == c[:-1])))[: len(a)]
    again = np.concatenate(([False], same[1:] & (i[1:] == i[:-1]) & (s[1:] == s[:-1])))[: len(a)]
    order, same = order[~again], same[~again]
    twice = np.append(same[1:], False)[: len(same)] & ~same & (not keep_first)  # the first of several here
    place = (start[order] << 18) | (n[order] << 10) | (offset[order] << 2) | (heavy[order].astype(np.int64) << 1) | twice
    return pa.RecordBatch.from_arrays([pa.array(doc[order]), pa.array(anchor[order]), pa.array(content[order]), pa.array(place), pa.array(same)], names=["doc_id", "anchor", "content", "place", "local"])


def meet(rows: DataFrame, keep_first: bool) -> DataFrame:
    """BLOCKS rows to FOUND rows: one shuffle by anchor (heavy ones by content), then a pass that holds one row at a time."""
    dealt = F.when(F.col("local"), F.xxhash64("doc_id", "place")).when(F.col("place").bitwiseAND(2) != 0, F.xxhash64("anchor", "content")).otherwise(F.col("anchor"))
    return rows.repartition(dealt).sortWithinPartitions("anchor", "content", "doc_id", "place").mapInArrow(_meet(keep_first), FOUND)


def _meet(keep_first: bool):
    def out(rows: np.ndarray, kind: int, whole: np.ndarray) -> pa.RecordBatch:
        place, n = rows[:, 3], len(rows)
        columns = [rows[:, 0], np.full(n, kind, np.int32), (place >> 18).astype(np.int32), ((place >> 10) & 255).astype(np.int32), ((place >> 2) & 255).astype(np.int32), rows[:, 1], rows[:, 2], whole]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["doc_id", "kind", "start", "windows", "offset", "anchor", "content", "whole"])

    def settle(rows: np.ndarray, members: np.ndarray, contested: np.ndarray) -> Iterator[pa.RecordBatch]:
        copied = (members > 1) & (not keep_first)
        look = contested | ((rows[:, 3] & 2) != 0)
        yield out(rows[look], CONTESTED, copied[look])
        yield out(rows[copied], COPY, copied[copied])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, members, other = None, 0, False  # the last content's first block; how many it has; whether its anchor has another content
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]], axis=1)
            local = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            if local.any():
                yield out(rows[local], COPY, np.ones(local.sum(), dtype=bool))
                rows = rows[~local]
            if not len(rows):
                continue
            if held is not None:
                rows = np.concatenate((held[None], rows))
            fresh_anchor = np.concatenate(([True], rows[1:, 1] != rows[:-1, 1]))
            fresh = fresh_anchor | np.concatenate(([True], rows[1:, 2] != rows[:-1, 2]))
            repeat = ~fresh & np.concatenate(([False], (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 3] >> 18 == rows[:-1, 3] >> 18)))
            firsts = np.flatnonzero(fresh)
            counts = np.bincount((np.cumsum(fresh) - 1)[~repeat], minlength=len(firsts)) + np.maximum.reduceat(rows[:, 3] & 1, firsts)
            follows = ~fresh_anchor[firsts]  # the anchor had another content before
            if held is not None:
                counts[0] = max(counts[0], members + counts[0] - 1)
                follows[0] = other
            contested = follows | np.append(~fresh_anchor[firsts[1:]], False)
            later = rows[~fresh & ~repeat]
            yield out(later, COPY, np.ones(len(later), dtype=bool))
            yield from settle(rows[firsts[:-1]], counts[:-1], contested[:-1])
            held, members, other = rows[firsts[-1]], int(counts[-1]), bool(follows[-1])
        if held is not None:
            yield from settle(held[None], np.array([members]), np.array([other]))

    return run
