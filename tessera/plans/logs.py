"""Queries over partitioned ordered logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import log
from ..sources.tables import BATCHES_SQL, RECORDS_SQL, SEGMENTS_SQL, TXNS_SQL, log_batches, log_records, segments, transactions
from .registry import query

NOW = 1_706_600_000


@query(f"WITH {RECORDS_SQL} SELECT part, event_id, \"offset\", key, bytes FROM records")
def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_records(spark, sf_dir).select("part", "event_id", "offset", "key", "bytes")


@query(f"WITH {RECORDS_SQL}, {BATCHES_SQL} SELECT * FROM batches")
def log_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_batches(log_records(spark, sf_dir))


@query(f"WITH {RECORDS_SQL}, {SEGMENTS_SQL} SELECT * FROM segments")
def log_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(log_records(spark, sf_dir))


@query(f"""WITH {RECORDS_SQL}, {BATCHES_SQL},
f AS (SELECT *, sum(bytes) OVER (PARTITION BY part ORDER BY batch ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY part ORDER BY batch) AS rn
      FROM batches WHERE last_offset >= 37)
SELECT part, batch, base_offset, last_offset, records, bytes, max_ts FROM f WHERE rn = 1 OR upto <= 1000""")
def log_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.fetch(log_batches(log_records(spark, sf_dir)), 37, 1000)


_ENDS = "ends AS (SELECT part, r AS replica, max(\"offset\") + 1 - r * (part + 3) AS \"end\" FROM records, (VALUES (0), (1), (2)) v(r) GROUP BY part, r)"
_OFFSETS = """offs AS (SELECT b.part, min(base_offset) AS log_start, any_value(hw) AS high_watermark, max(last_offset) + 1 AS log_end
  FROM batches b JOIN (SELECT part, list_sort(list("end"), 'DESC')[2] AS hw FROM ends GROUP BY part) e ON e.part = b.part GROUP BY b.part)"""


def _replica_ends(records: DataFrame) -> DataFrame:
    end = F.max("offset") + 1
    return records.groupBy("part").agg(end.alias("top")).select("part", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("replica"), "top").select("part", "replica", (F.col("top") - F.col("replica") * (F.col("part") + 3)).alias("end"))


@query(f"WITH {RECORDS_SQL}, {BATCHES_SQL}, {_ENDS}, {_OFFSETS} SELECT * FROM offs")
def log_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = log_records(spark, sf_dir)
    return log.offsets(log_batches(records), _replica_ends(records), 2)


@query(f"""WITH {RECORDS_SQL}, {BATCHES_SQL}, {_ENDS}, {_OFFSETS},
f AS (SELECT b.*, sum(bytes) OVER (PARTITION BY b.part ORDER BY batch ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY b.part ORDER BY batch) AS rn
      FROM batches b JOIN offs USING (part) WHERE last_offset >= 40 AND last_offset < high_watermark)
SELECT part, batch, base_offset, last_offset, records, bytes, max_ts FROM f WHERE rn = 1 OR upto <= 9000""")
def log_fetch_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = log_records(spark, sf_dir)
    batches = log_batches(records)
    ends = log.offsets(batches, _replica_ends(records), 2).select("part", F.col("high_watermark").alias("end"))
    return log.fetch(batches, 40, 9000, ends)


@query(f"""WITH {RECORDS_SQL}, {BATCHES_SQL}, {_ENDS}, {_OFFSETS}
SELECT part, ts, CASE ts WHEN -2 THEN log_start WHEN -1 THEN log_end ELSE -1 END AS "offset" FROM offs, (VALUES (-2), (-1), (1700000000)) v(ts)""")
def log_list_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = log_records(spark, sf_dir)
    ends = log.offsets(log_batches(records), _replica_ends(records), 2)
    requests = ends.select("part", F.explode(F.array(F.lit(-2), F.lit(-1), F.lit(1700000000))).alias("ts"))
    return log.list_offsets(requests, ends)


@query(f"""WITH {RECORDS_SQL}, {BATCHES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY batch) - 1 AS ordinal FROM batches WHERE batch % 7 <> 3)
SELECT part, ordinal, base_offset, batch FROM o WHERE ordinal % 4 = 0""")
def log_sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.sparse_index(log_batches(log_records(spark, sf_dir)).filter("batch % 7 <> 3"))


@query(f"WITH {RECORDS_SQL}, {BATCHES_SQL}, {_ENDS}, {_OFFSETS} SELECT ends.part, replica, greatest(log_end - \"end\", 0) AS lag FROM ends JOIN offs ON offs.part = ends.part")
def log_replica_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = log_records(spark, sf_dir)
    ends = _replica_ends(records)
    return log.replica_progress(ends, log.offsets(log_batches(records), ends, 2))


_RETENTION = f"""picked AS (SELECT * FROM (SELECT *, sum(payload_bytes) OVER (PARTITION BY part ORDER BY segment DESC ROWS UNBOUNDED PRECEDING) AS with_newer FROM segments) x
  WHERE max_ts < {NOW} - 2000000 OR with_newer > 12000)"""
_PICKED = ["part", "segment", "base_offset", "end_offset", "batch_count", "payload_bytes", "min_ts", "max_ts"]


@query(f"WITH {RECORDS_SQL}, {SEGMENTS_SQL}, {_RETENTION} SELECT {', '.join(_PICKED)} FROM picked")
def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.retention_candidates(segments(log_records(spark, sf_dir)), 2_000_000, 12_000, NOW).select(*_PICKED)


@query(f"WITH {RECORDS_SQL}, {SEGMENTS_SQL}, {_RETENTION} SELECT part, arg_max(end_offset, segment) AS log_start FROM picked GROUP BY part")
def log_start_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.log_start_after(log.retention_candidates(segments(log_records(spark, sf_dir)), 2_000_000, 12_000, NOW))


_COMPACT = f"""r AS (SELECT *, "offset" // 16 AS batch, "offset" // 256 AS segment, "offset" % 211 = 5 AS control, CASE WHEN event_id % 389 > 0 THEN key END AS k,
  CASE WHEN "offset" % 97 = 3 THEN producer ELSE -1 END AS pid, "offset" // 16 % 53 = 7 AS faulty FROM records),
latest AS (SELECT part, k, max(batch) AS latest FROM r WHERE k IS NOT NULL AND NOT faulty GROUP BY part, k),
alive AS (SELECT DISTINCT r.part, r.batch FROM r JOIN latest l ON l.part = r.part AND l.k = r.k WHERE NOT faulty AND batch = latest),
rims AS (SELECT part, segment, min(batch) AS lo, max(batch) AS hi FROM r GROUP BY part, segment),
tops AS (SELECT part, max(segment) AS end_segment FROM r GROUP BY part),
b AS (SELECT part, segment, batch, min("offset") AS base_offset, bool_or(faulty) AS undecodable, bool_or(NOT faulty AND k IS NULL) AS null_key,
             bool_or(faulty OR control OR pid >= 0 OR k IS NULL) AS opaque,
             bool_or(NOT faulty AND k IS NOT NULL AND value IS NULL AND greatest({NOW} - ts, 0) < 600000) AS young_tombstone FROM r GROUP BY part, segment, batch),
c AS (SELECT b.*, a.batch IS NOT NULL AS is_latest, b.batch = lo OR b.batch = hi AS rim, b.segment < end_segment AS sealed
      FROM b LEFT JOIN alive a ON a.part = b.part AND a.batch = b.batch JOIN rims ON rims.part = b.part AND rims.segment = b.segment JOIN tops ON tops.part = b.part),
flags AS (SELECT *, NOT sealed OR opaque OR young_tombstone OR is_latest OR rim AS kept FROM c)"""


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("offset")
    records = log_records(spark, sf_dir).withColumns({"batch": F.floor(o / 16), "segment": F.floor(o / 256), "control": o % 211 == 5, "key": F.when(F.col("event_id") % 389 > 0, F.col("key")), "producer": F.when(o % 97 == 3, F.col("producer")).otherwise(-1), "faulty": F.floor(o / 16) % 53 == 7})
    return log.compact(records, NOW, 600_000, records.groupBy("part").agg(F.max("segment").alias("end_segment")))


@query(f"WITH {RECORDS_SQL}, {_COMPACT} SELECT * FROM flags")
def log_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compacted(spark, sf_dir)


@query(f"""WITH {RECORDS_SQL}, {_COMPACT} SELECT part, count(*) AS input_batches, count(*) FILTER (kept) AS retained, count(*) FILTER (NOT kept) AS obsolete, count(*) FILTER (undecodable) AS undecodable,
  count(*) FILTER (null_key) AS null_key, count(*) FILTER (young_tombstone) AS protected_tombstones FROM flags GROUP BY part""")
def log_compaction_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_if
    return _compacted(spark, sf_dir).groupBy("part").agg(F.count(F.lit(1)).alias("input_batches"), n("kept").alias("retained"), n(~F.col("kept")).alias("obsolete"), n("undecodable").alias("undecodable"), n("null_key").alias("null_key"), n("young_tombstone").alias("protected_tombstones"))


_HW = "hw AS (SELECT part, max(\"offset\") + 1 AS high_watermark FROM records GROUP BY part)"
_LSO = "lso AS (SELECT hw.part, coalesce(min(first_offset) FILTER (status = 'ongoing'), any_value(high_watermark)) AS lso FROM hw LEFT JOIN txns ON txns.part = hw.part GROUP BY hw.part)"


def _lso(records: DataFrame, txns: DataFrame) -> DataFrame:
    return log.last_stable_offset(txns, records.groupBy("part").agg((F.max("offset") + 1).alias("high_watermark")))


@query(f"WITH {RECORDS_SQL}, {TXNS_SQL}, {_HW}, {_LSO} SELECT * FROM lso")
def txn_lso(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = log_records(spark, sf_dir)
    return _lso(records, transactions(records))


@query(f"WITH {RECORDS_SQL}, {TXNS_SQL} SELECT part, producer, first_offset, last_offset FROM txns WHERE status = 'aborted' AND last_offset >= 120 AND first_offset < (SELECT max(\"offset\") // 2 FROM records)")
def txn_aborted_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = log_records(spark, sf_dir)
    through = (records.agg(F.max("offset")).first()[0] or 0) // 2
    return log.aborted_ranges(transactions(records), 120, through)


_ALL_STABLE = "SELECT part, producer, txn, first_offset, last_offset, CASE WHEN status = 'ongoing' AND first_offset < 1200 THEN 'committed' ELSE status END AS status FROM txns"


@query(f"""WITH {RECORDS_SQL}, {TXNS_SQL.replace('txns AS', 't0 AS')}, txns AS ({_ALL_STABLE.replace('FROM txns', 'FROM t0')}), {_HW}, {_LSO}
SELECT r.part, r."offset", r.event_id FROM records r JOIN lso USING (part) WHERE r."offset" < lso AND NOT EXISTS (
  SELECT 1 FROM txns t WHERE t.status = 'aborted' AND t.part = r.part AND t.producer = r.producer AND r."offset" BETWEEN t.first_offset AND t.last_offset)""")
def read_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = log_records(spark, sf_dir)
    txns = transactions(records).withColumn("status", F.when((F.col("status") == "ongoing") & (F.col("first_offset") < 1200), "committed").otherwise(F.col("status")))
    return log.read_committed(records, txns, _lso(records, txns)).select("part", "offset", "event_id")


_COMMITTED = """commits AS (SELECT 'g' || CAST(user_id % 20 AS VARCHAR) AS "group", event_type AS topic, user_id % 4 AS part, event_id * 3 % 1000 AS "offset", CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events),
committed AS (SELECT "group", topic, part, arg_max("offset", ROW(ts, "offset")) AS "offset", max(ts) AS ts FROM commits GROUP BY 1, 2, 3)"""


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import seconds, table

    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("g"), (F.col("user_id") % 20).cast("string")).alias("group"), F.col("event_type").alias("topic"), (F.col("user_id") % 4).alias("part"), (F.col("event_id") * 3 % 1000).alias("offset"), seconds("ts").alias("ts"))


@query(f"WITH {_COMMITTED} SELECT * FROM committed")
def group_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.last_commits(_commits(spark, sf_dir))


@query(f"""WITH {_COMMITTED} SELECT q."group", q.topic, q.part, coalesce(c."offset", -1) AS "offset" FROM
(SELECT 'g' || CAST(a AS VARCHAR) AS "group", b AS topic, CAST(p AS BIGINT) AS part FROM range(0, 24, 5) x(a), (VALUES ('click'), ('error'), ('none')) y(b), range(0, 5) z(p)) q
LEFT JOIN committed c ON c."group" = q."group" AND c.topic = q.topic AND c.part = q.part""")
def group_offset_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.range(0, 24, 5).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("group")).select("group", F.explode(F.array(F.lit("click"), F.lit("error"), F.lit("none"))).alias("topic")).select("group", "topic", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("part"))
    return log.fetch_offsets(asked, log.last_commits(_commits(spark, sf_dir)))


_MEMBERS = "members AS (SELECT 'g' || CAST(user_id % 20 AS VARCHAR) AS \"group\", 'm' || CAST(user_id AS VARCHAR) AS member, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last_seen, any_value(3000 + user_id % 7 * 60000) AS session_timeout FROM events GROUP BY user_id)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import seconds, table

    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max(seconds("ts")).alias("last_seen")).select(F.concat(F.lit("g"), (F.col("user_id") % 20).cast("string")).alias("group"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("member"), "last_seen", (F.col("user_id") % 7 * 60000 + 3000).alias("session_timeout"))


@query(f"WITH {_MEMBERS} SELECT *, min(member) OVER (PARTITION BY \"group\") AS leader FROM members WHERE {NOW} - last_seen <= session_timeout")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.alive_members(_members(spark, sf_dir), NOW)


@query(f"""WITH {_COMMITTED}, {_MEMBERS} SELECT c.* FROM committed c WHERE c.ts + 50000 < {NOW}
AND NOT EXISTS (SELECT 1 FROM members m WHERE m."group" = c."group" AND {NOW} + 60000 - last_seen <= session_timeout)""")
def group_offset_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.expired_offsets(log.last_commits(_commits(spark, sf_dir)), log.alive_members(_members(spark, sf_dir), NOW + 60_000), NOW, 50_000)


@query(f"""WITH {RECORDS_SQL}, {SEGMENTS_SQL}, {_RETENTION}, {_HW}
SELECT s.part, any_value(high_watermark) AS high_watermark, sum(s.payload_bytes)::BIGINT AS retained_bytes, count(*) AS segments,
  coalesce(any_value(p.reclaimable), 0)::BIGINT AS reclaimable_bytes
FROM segments s JOIN hw ON hw.part = s.part LEFT JOIN (SELECT part, sum(payload_bytes) AS reclaimable FROM picked GROUP BY part) p ON p.part = s.part GROUP BY s.part""")
def broker_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = log_records(spark, sf_dir)
    parts = segments(records)
    reclaim = log.retention_candidates(parts, 2_000_000, 12_000, NOW).groupBy("part").agg(F.sum("payload_bytes").alias("r"))
    sums = parts.groupBy("part").agg(F.max("end_offset").alias("high_watermark"), F.sum("payload_bytes").alias("retained_bytes"), F.count(F.lit(1)).alias("segments"))
    return sums.join(reclaim, "part", "left").select("part", "high_watermark", "retained_bytes", "segments", F.coalesce("r", F.lit(0)).alias("reclaimable_bytes"))


@query("SELECT 1000000 % 7 AS seed, count(*) AS updates, count(DISTINCT user_id) AS unique_keys, count(*) - count(DISTINCT user_id) AS obsolete, (count(*) - count(DISTINCT user_id)) * 100 // count(*) AS obsolete_percent FROM events")
def compaction_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    total, keys = F.sum("n"), F.count(F.lit(1))
    return e.agg(F.lit(1000000 % 7).alias("seed"), total.alias("updates"), keys.alias("unique_keys"), (total - keys).alias("obsolete"), F.floor((total - keys) * 100 / total).alias("obsolete_percent"))
