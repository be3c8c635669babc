"""The input tables and the keyed, logged and linked views derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import running_total


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key mutations: namespace, key, revision, op (put or delete), cid, value_kind, committed_at."""
    events = table(spark, sf_dir, "events")
    return events.select(
        (F.col("user_id") % 16).alias("namespace"),
        F.lpad(F.col("user_id").cast("string"), 10, "0").alias("key"),
        (F.col("event_id") + 1).alias("revision"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        F.md5(F.col("event_id").cast("string")).alias("cid"),
        F.col("event_type").alias("value_kind"),
        seconds("ts").alias("committed_at"),
    )


def revision_at(rows: DataFrame, eighths: int) -> int:
    """The revision so many eighths of the way to the head."""
    return (rows.agg(F.max("revision")).first()[0] or 0) * eighths // 8


REVISION_AT = "(SELECT max(revision) * {} // 8 FROM changes)".format

CHANGES_SQL = """changes AS (
  SELECT user_id % 16 AS namespace, lpad(CAST(user_id AS VARCHAR), 10, '0') AS key, event_id + 1 AS revision,
         CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, md5(CAST(event_id AS VARCHAR)) AS cid,
         event_type AS value_kind, CAST(floor(epoch(ts)) AS BIGINT) AS committed_at
  FROM events)"""


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a partitioned log: part, offset, event_id, key, value (null: tombstone), bytes, ts, producer."""
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("part"),
        "event_id",
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"),
        F.when(F.col("value") >= 5, F.col("value")).alias("value"),
        F.length("props").cast("bigint").alias("bytes"),
        seconds("ts").alias("ts"),
        (F.col("user_id") % 8).alias("producer"),
    )
    return running_total(events, ["part"], ["event_id"], F.lit(1), "offset", inclusive=False)


RECORDS_SQL = """records AS (
  SELECT user_id % 4 AS part, event_id, event_type || ':' || CAST(user_id AS VARCHAR) AS key,
         CASE WHEN value >= 5 THEN value END AS value, CAST(length(props) AS BIGINT) AS bytes,
         CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id % 8 AS producer,
         row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS "offset"
  FROM events)"""

BATCH = 16
SEGMENT = 256


def log_batches(records: DataFrame) -> DataFrame:
    """part, batch, base_offset, last_offset, records, bytes, max_ts: sixteen consecutive records a batch."""
    return (
        records.withColumn("batch", F.floor(F.col("offset") / BATCH))
        .groupBy("part", "batch")
        .agg(F.min("offset").alias("base_offset"), F.max("offset").alias("last_offset"), F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("bytes"), F.max("ts").alias("max_ts"))
    )


BATCHES_SQL = """batches AS (
  SELECT part, "offset" // 16 AS batch, min("offset") AS base_offset, max("offset") AS last_offset,
         count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, max(ts) AS max_ts
  FROM records GROUP BY part, "offset" // 16)"""


def segments(records: DataFrame) -> DataFrame:
    """part, segment, base_offset, end_offset, batch_count, payload_bytes, min_ts, max_ts."""
    return (
        records.withColumn("segment", F.floor(F.col("offset") / SEGMENT))
        .groupBy("part", "segment")
        .agg(F.min("offset").alias("base_offset"), (F.max("offset") + 1).alias("end_offset"), F.count_distinct(F.floor(F.col("offset") / BATCH)).alias("batch_count"), F.sum("bytes").alias("payload_bytes"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
    )


SEGMENTS_SQL = """segments AS (
  SELECT part, "offset" // 256 AS segment, min("offset") AS base_offset, max("offset") + 1 AS end_offset,
         count(DISTINCT "offset" // 16) AS batch_count, CAST(sum(bytes) AS BIGINT) AS payload_bytes,
         min(ts) AS min_ts, max(ts) AS max_ts
  FROM records GROUP BY part, "offset" // 256)"""


def transactions(records: DataFrame) -> DataFrame:
    """part, producer, txn, status, first_offset, last_offset: 50 offsets a transaction, status from a hash."""
    digit = F.substring(F.md5(F.concat_ws(":", F.col("part").cast("string"), F.col("producer").cast("string"), F.col("txn").cast("string"))), 1, 1)
    grouped = records.withColumn("txn", F.floor(F.col("offset") / 50)).groupBy("part", "producer", "txn").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))
    return grouped.withColumn("status", F.when(digit < "9", "committed").when(digit < "d", "aborted").otherwise("ongoing"))


TXNS_SQL = """txns AS (
  SELECT *, CASE WHEN d < '9' THEN 'committed' WHEN d < 'd' THEN 'aborted' ELSE 'ongoing' END AS status
  FROM (SELECT part, producer, "offset" // 50 AS txn, min("offset") AS first_offset, max("offset") AS last_offset,
               substr(md5(CAST(part AS VARCHAR) || ':' || CAST(producer AS VARCHAR) || ':' || CAST("offset" // 50 AS VARCHAR)), 1, 1) AS d
        FROM records GROUP BY part, producer, "offset" // 50) g)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path, size: page addresses as object keys, without scheme, query and fragment."""
    pages = table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-zA-Z]+://", ""), r"[?#].*$", "")
    return pages.select("page_id", F.regexp_replace(path, "/+$", "").alias("path"), F.length("html").cast("bigint").alias("size"))


PATHS_SQL = r"""paths AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[?#].*$', ''), '/+$', '') AS path,
         CAST(length(html) AS BIGINT) AS size
  FROM pages)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, child: foreign keys region > nation > customer > order as links of a graph."""
    link = lambda df, p, pk, c, ck: df.select(F.concat(F.lit(p), F.col(pk).cast("string")).alias("parent"), F.concat(F.lit(c), F.col(ck).cast("string")).alias("child"))
    nations = link(table(spark, sf_dir, "nation"), "r", "n_regionkey", "n", "n_nationkey")
    customers = link(table(spark, sf_dir, "customer"), "n", "c_nationkey", "c", "c_custkey")
    orders = link(table(spark, sf_dir, "orders"), "c", "o_custkey", "o", "o_orderkey")
    return nations.union(customers).union(orders)


EDGES_SQL = """edges AS (
  SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS parent, 'n' || CAST(n_nationkey AS VARCHAR) AS child FROM nation
  UNION ALL SELECT 'n' || CAST(c_nationkey AS VARCHAR), 'c' || CAST(c_custkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'c' || CAST(o_custkey AS VARCHAR), 'o' || CAST(o_orderkey AS VARCHAR) FROM orders)"""
