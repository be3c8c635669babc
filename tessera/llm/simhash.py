"""Operator 8, SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, with exclusive-or and bit counts over numpy tiles, and
tile pairs whose population counts differ beyond the radius are skipped. Comparing every
tile with every other would grow with the square of the table, so tiles are formed inside
buckets that lose nothing: of ``BLOCKS`` blocks of bits, ``radius`` differing bits leave all
but ``radius`` blocks equal, so two linked fingerprints share a bucket for at least one
choice of left-out blocks. A bucket fixes 48 of 64 bits; it holds 65,536 distinct
fingerprints at most, whatever the size of a group of copies. So the buckets are the index that
makes the work linear, and most hold one or two fingerprints; tiles are what a full one needs.

``near_sets`` links texts of a given similarity instead, as the pipeline does.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, checkpointed
from .components import connected_components

SHINGLE = 3
RADIUS = 2
BLOCKS = 8
TILE = 2048
_CHUNK = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of hashes: bit i is set if it is set in over half of them."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of the XXH64 of all shingles, repeats included; of none it is zero."""
    words = text.lower().split()  # on bytes: lowers A-Z, splits at the six ASCII white spaces
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[k - 1 :].tolist())], dtype="<u8"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in bytes_of(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def tile_links(fp: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> np.ndarray:
    """For each of the distinct fingerprints, the index of the first one it is linked with."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp, weight = fp[order], np.bitwise_count(fp[order]).astype(np.int64)
    label = np.arange(len(fp))
    for i in range(0, len(fp), tile):
        for j in range(i, len(fp), tile):
            if weight[j] - weight[min(i + tile, len(fp)) - 1] > radius:
                break
            a, b = np.nonzero(np.bitwise_count(fp[i : i + tile, None] ^ fp[None, j : j + tile]) <= radius)
            a, b = label[a + i], label[b + j]
            while (apart := a != b).any():
                a, b = a[apart], b[apart]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label != label[label]).any():
                    label = label[label]
                a, b = label[a], label[b]
    first = np.full(len(fp), len(fp))
    np.minimum.at(first, label, order)
    found = np.empty(len(fp), dtype=np.int64)
    found[order] = first[label]
    return found


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(rows)]))
            pairs = starts[ends - starts == 2]
            near = pairs[np.bitwise_count(rows[pairs, 2].view(np.uint64) ^ rows[pairs + 1, 2].view(np.uint64)) <= radius]
            a, b = [rows[near, 3]], [rows[near + 1, 3]]
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                to = tile_links(rows[s:e, 2].view(np.uint64), radius)
                linked = np.flatnonzero(to != np.arange(e - s))
                a.append(rows[s:e, 3][linked])
                b.append(rows[s:e, 3][to[linked]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            rows = np.ascontiguousarray(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            if len(rows) == 0:
                continue
            whole = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
            upto = whole[-1] + 1 if len(whole) else 0
            if held and (upto or np.any(held[-1][-1, :2] != rows[-1, :2])):
                yield links(_columns(np.concatenate([*held, rows[:upto]])))
                held = []
            elif upto:
                yield links(_columns(rows[:upto]))
            held.append(rows[upto:])
        if held:
            yield links(_columns(np.concatenate(held)))

    return run


def _columns(rows: np.ndarray) -> np.ndarray:
    """The same rows with each column contiguous, so that a column can be viewed as another type."""
    return np.asfortranarray(rows)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id.

    * null, empty or white text: fingerprint zero, linked like any other.
    * null doc_id: the row's component is that of its fingerprint's other rows, null if it has none.
    * rows that repeat an id are in the component of each of their fingerprints.
    * no rows: no rows. Other columns of the input are not read.
    """
    prints = checkpointed(fingerprints(docs, doc_id, text, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    width = 64 // BLOCKS
    masks = [sum(((1 << width) - 1) << (width * i) for i in range(BLOCKS) if i not in out) for out in combinations(range(BLOCKS), radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in signed])).alias("choice", "bucket")
    tiles = nodes.dropna().select(keys, "fp", "node").repartition("choice", "bucket").sortWithinPartitions("choice", "bucket")
    components = connected_components(tiles.mapInArrow(_bucket_links(radius), "a bigint, b bigint"))
    named = nodes.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
