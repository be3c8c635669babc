"""Content ids, CRC-32C and log record batches (the public version-2 wire layout)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

VERSION = 1
#: So many record batches are Python objects at once.
_ROWS = 256


def varint(n: int) -> bytes:
    """Unsigned LEB128."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def content_id(codec: int, payload: Column) -> Column:
    """version:codec:digest. The digest covers version, codec, size and payload; SHA-256, as Spark has no BLAKE3."""
    size = F.unhex(F.lpad(F.hex(F.octet_length(payload)), 16, "0"))
    digest = F.sha2(F.concat(F.lit(bytes([VERSION]) + varint(codec)), size, payload.cast("binary")), 256)
    return F.concat_ws(":", F.lit(str(VERSION)), F.lit(str(codec)), digest)


@cache
def _crc_table() -> np.ndarray:
    """Fixed value: the Castagnoli polynomial, reflected."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    return table


def crc32c_of(values: list[bytes]) -> np.ndarray:
    """CRC-32C of each value; all values advance together, a byte at a time."""
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(-lengths, kind="stable")
    data, offsets = np.frombuffer(b"".join(values), dtype=np.uint8), (np.cumsum(lengths) - lengths)[order]
    crc, table = np.full(len(values), 0xFFFFFFFF, dtype=np.uint32), _crc_table()
    alive = len(values)
    for i in range(int(lengths.max(initial=0))):
        while alive and lengths[order[alive - 1]] <= i:
            alive -= 1
        crc[:alive] = table[(crc[:alive] ^ data[offsets[:alive] + i]) & 255] ^ (crc[:alive] >> 8)
    out = np.empty(len(values), dtype=np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


@F.pandas_udf(LongType())
def crc32c(values: pd.Series) -> pd.Series:
    """CRC-32C of a binary column; null for null."""
    there = values.notna()
    out = pd.Series([None] * len(values), dtype="Int64", index=values.index)
    out[there] = crc32c_of([bytes(v) for v in values[there]]).astype(np.int64)
    return out


def _zigzag(n: int) -> bytes:
    return varint((n << 1) ^ (n >> 63) if n >= 0 else ((-n) << 1) - 1)


def _read(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return (n >> 1) ^ -(n & 1), at
        shift += 7


_HEADER = struct.Struct(">qiibIhiqqqhii")
_AFTER_CRC = 21


def encode_batch(base: int, producer: int, records: list[dict]) -> bytes:
    """One record batch, its checksum still 0 (see ``sealed``). records: delta, ts, key, value (bytes or None)."""
    body, first = bytearray(), records[0]["ts"]
    for r in records:
        parts = bytearray(b"\0") + _zigzag(r["ts"] - first) + _zigzag(r["delta"])
        for v in (r["key"], r["value"]):
            parts += _zigzag(-1) if v is None else _zigzag(len(v)) + v
        parts += b"\0"
        body += _zigzag(len(parts)) + parts
    fields = (0, records[-1]["delta"], first, max(r["ts"] for r in records), producer, 0, -1, len(records))
    return _HEADER.pack(base, _HEADER.size - 12 + len(body), 0, 2, 0, *fields) + bytes(body)


def sealed(batches: list[bytes]) -> list[bytes]:
    """The batches with their checksums, which are computed together."""
    sums = crc32c_of([b[_AFTER_CRC:] for b in batches]).tolist()
    return [b[: _AFTER_CRC - 4] + c.to_bytes(4, "big") + b[_AFTER_CRC:] for b, c in zip(batches, sums)]


def faults_of(batches: list[bytes]) -> list[str | None]:
    """Why each batch is refused: length, magic, crc, compression or count; None if it is sound."""
    sums = crc32c_of([b[_AFTER_CRC:] for b in batches]).tolist()
    return [_fault(b, c) for b, c in zip(batches, sums)]


def _fault(batch: bytes, checksum: int) -> str | None:
    if len(batch) < _HEADER.size:
        return "length"
    _, length, _, magic, crc, attributes, last, _, _, _, _, _, count = _HEADER.unpack_from(batch)
    if length != len(batch) - 12:
        return "length"
    if magic != 2:
        return "magic"
    if crc != checksum:
        return "crc"
    if attributes & 7:
        return "compression"
    return None if count > 0 and last >= count - 1 and sum(1 for _ in decode_batch(batch)) == count else "count"


def decode_batch(batch: bytes) -> Iterator[tuple]:
    """(offset, ts, producer, key, value) of each record."""
    base, _, _, _, _, _, _, first, _, producer, _, _, _ = _HEADER.unpack_from(batch)
    at = _HEADER.size
    while at < len(batch):
        length, at = _read(batch, at)
        end = at + length
        ts, at = _read(batch, at + 1)
        delta, at = _read(batch, at)
        pair = []
        for _ in range(2):
            n, at = _read(batch, at)
            pair.append(None if n < 0 else batch[at : at + n])
            at += max(n, 0)
        yield base + delta, first + ts, producer, *pair
        at = end


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches by few rows: what a task holds as Python objects stays as small however full its batches are."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def encode_batches(records: DataFrame) -> DataFrame:
    """part, base_offset, batch. records: part, base_offset, producer, offset, ts, key, value; a batch's rows fit a task."""
    grouped = records.groupBy("part", "base_offset", "producer").agg(F.array_sort(F.collect_list(F.struct("offset", "ts", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")))).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _parts(batches):
            part, base_offset, producers, rows = some.columns
            out = []
            for producer, r in zip(producers.to_pylist(), rows.to_pylist()):
                base = r[0]["offset"]
                out.append(encode_batch(base, producer, [{"delta": x["offset"] - base, "ts": x["ts"], "key": x["key"], "value": x["value"]} for x in r]))
            yield pa.RecordBatch.from_arrays([part.cast(pa.int64()), base_offset.cast(pa.int64()), pa.array(sealed(out), pa.binary())], names=["part", "base_offset", "batch"])

    return grouped.select("part", "base_offset", "producer", "r").mapInArrow(run, "part bigint, base_offset bigint, batch binary")


def decode_batches(batches: DataFrame) -> DataFrame:
    """part, offset, ts, producer, key, value of the sound batches' records. batches: part, batch."""
    names, kinds = ["part", "offset", "ts", "producer", "key", "value"], [pa.int64()] * 4 + [pa.binary()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _parts(batches):
            raw = some.column(1).to_pylist()
            rows = [(p, *r) for p, b, fault in zip(some.column(0).to_pylist(), raw, faults_of(raw)) if fault is None for r in decode_batch(b)]
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return batches.select("part", "batch").mapInArrow(run, "part bigint, offset bigint, ts bigint, producer bigint, key binary, value binary")


def faults(batches: DataFrame) -> DataFrame:
    """part, base_offset, fault of the batches that are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _parts(batches):
            found = pa.array(faults_of(some.column(2).to_pylist()), pa.string())
            out = pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), some.column(1).cast(pa.int64()), found], names=["part", "base_offset", "fault"])
            yield out.filter(found.is_valid())

    return batches.select("part", "base_offset", "batch").mapInArrow(run, "part bigint, base_offset bigint, fault string")
