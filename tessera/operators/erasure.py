"""Reed-Solomon erasure coding of payloads: any ``data`` of the data + parity shards restore a stripe."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@cache
def _field() -> tuple[np.ndarray, np.ndarray]:
    """(powers, logarithms) of GF(256); fixed value: the polynomial x^8 + x^4 + x^3 + x^2 + 1."""
    powers, logs, x = np.zeros(512, dtype=np.uint8), np.zeros(256, dtype=np.int64), 1
    for i in range(255):
        powers[i] = powers[i + 255] = x
        logs[x] = i
        x = x << 1 ^ (0x11D if x & 128 else 0)
    return powers, logs


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product over GF(256)."""
    powers, logs = _field()
    out = np.zeros((a.shape[0], b.shape[1]), dtype=np.uint8)
    for k in range(a.shape[1]):
        x, y = a[:, k, None], b[k][None]
        out ^= np.where((x == 0) | (y == 0), 0, powers[logs[x] + logs[y]]).astype(np.uint8)
    return out


def _inverse(m: np.ndarray) -> np.ndarray:
    powers, logs = _field()
    n = len(m)
    work = np.concatenate((m, np.eye(n, dtype=np.uint8)), axis=1)
    for i in range(n):
        pivot = i + int(np.flatnonzero(work[i:, i])[0])
        work[[i, pivot]] = work[[pivot, i]]
        scale = np.array([[powers[255 - logs[work[i, i]]]]], dtype=np.uint8)
        work[i] = _product(scale, work[i][None])[0]
        for j in range(n):
            if j != i and work[j, i]:
                work[j] ^= _product(work[j, i].reshape(1, 1), work[i][None])[0]
    return work[:, n:]


@cache
def _parity(data: int, parity: int) -> np.ndarray:
    """A Cauchy matrix: every square part of it has an inverse."""
    powers, logs = _field()
    x, y = np.arange(data, data + parity)[:, None], np.arange(data)[None]
    return powers[255 - logs[x ^ y]]


def encode(payload: bytes, data: int, parity: int) -> list[bytes]:
    size = max(1, -(-len(payload) // data))
    shards = np.frombuffer(payload.ljust(size * data, b"\0"), dtype=np.uint8).reshape(data, size)
    return [s.tobytes() for s in (*shards, *_product(_parity(data, parity), shards))]


def restore(shards: dict[int, bytes], size: int, data: int, parity: int) -> bytes | None:
    """The payload from any ``data`` shards by index; None if fewer are there."""
    if len(shards) < data:
        return None
    at = sorted(shards)[:data]
    have = np.stack([np.frombuffer(shards[i], dtype=np.uint8) for i in at])
    if at != list(range(data)):
        have = _product(_inverse(np.concatenate((np.eye(data, dtype=np.uint8), _parity(data, parity)))[at]), have)
    return have.tobytes()[:size]


def encode_stripes(objects: DataFrame, data: int, parity: int) -> DataFrame:
    """object, size, shard, payload: one row a shard. objects: object, content (string or binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(o, len(c), i, s) for o, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if c is not None for i, s in enumerate(encode(c, data, parity))]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["object", "size", "shard", "payload"])

    return objects.select("object", F.col("content").cast("binary").alias("content")).mapInArrow(run, "object bigint, size bigint, shard int, payload binary")


def restore_stripes(shards: DataFrame, data: int, parity: int) -> DataFrame:
    """object, content of each object with enough shards left; null content where there are too few."""
    grouped = shards.groupBy("object").agg(F.max("size").alias("size"), F.collect_list(F.struct("shard", "payload")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [restore({x["shard"]: x["payload"] for x in s}, n, data, parity) for n, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["object", "content"])

    return grouped.mapInArrow(run, "object bigint, content binary")
