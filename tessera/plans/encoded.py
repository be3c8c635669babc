"""Queries over encoded data and streams: content ids, record batches, erasure coding, streaming appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.lineage import new_path
from ..operators import erasure
from ..sources.tables import RECORDS_SQL, log_records, table
from ..streaming import appends
from .linked import _appends
from .registry import ORACLES, query


@query("SELECT doc_id, '1:5:' || sha256(unhex('0105' || printf('%016x', octet_length(encode(text)))) || encode(text)) AS cid FROM documents")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", codec.content_id(5, F.col("text")).alias("cid"))


@query("""WITH RECURSIVE g(n, k, c) AS (SELECT n, 0, n FROM range(256) r(n) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END FROM g WHERE k < 8),
t AS (SELECT list(c ORDER BY n) AS t FROM g WHERE k = 8), h AS (SELECT page_id, hex(encode(html)) AS h FROM pages),
b AS (SELECT page_id, list_prepend(4294967295::BIGINT, [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) for i in range(0, length(h) // 2)]) AS bytes FROM h)
SELECT page_id, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS crc32c FROM b, t""")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", codec.crc32c(F.col("html").cast("binary")).alias("crc32c"))


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = log_records(spark, sf_dir).withColumn("base_offset", F.floor(F.col("offset") / 64) * 64)
    return codec.encode_batches(records.withColumn("value", F.col("value").cast("string")))


@query(f"WITH {RECORDS_SQL} SELECT part, \"offset\", ts, producer, key, value IS NULL AS tombstone FROM records")
def record_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = codec.decode_batches(_batches(spark, sf_dir))
    return decoded.select("part", "offset", "ts", "producer", F.col("key").cast("string").alias("key"), F.col("value").isNull().alias("tombstone"))


@query(f"WITH {RECORDS_SQL} SELECT DISTINCT part, \"offset\" // 64 * 64 AS base_offset, 'crc' AS fault FROM records WHERE \"offset\" // 64 % 5 = 2")
def record_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("base_offset") / 64 % 5 == 2, F.concat(F.expr("substring(batch, 1, length(batch) - 1)"), F.unhex(F.lit("7F")))).otherwise(F.col("batch"))
    return codec.faults(_batches(spark, sf_dir).withColumn("batch", bad)).distinct()


@query("SELECT doc_id AS object, CASE WHEN doc_id % 10 <> 9 THEN md5(text) END AS content_md5 FROM documents")
def erasure_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object"), F.col("text").alias("content"))
    shards = erasure.encode_stripes(docs, 4, 2)
    lost = F.pmod(F.col("shard") - F.col("object"), F.lit(6))
    left = shards.filter(lost >= F.when(F.col("object") % 10 == 9, 3).otherwise(2))
    return erasure.restore_stripes(left, 4, 2).select("object", F.md5("content").alias("content_md5"))


@query(ORACLES["idempotent_append"])
def stream_idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "appends")
    _appends(spark, sf_dir).withColumn("epoch", F.col("epoch").cast("int")).write.parquet(path)
    return appends.run_available(appends.decide_appends(appends.follow(spark, path)))


@query("""SELECT start, event_type, n FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) w
WHERE start + INTERVAL '1' HOUR <= (SELECT max(ts) FROM events) - INTERVAL '10' MINUTE""")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "events")
    table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return appends.run_available(appends.windowed_counts(appends.follow(spark, path)))
