"""Partitioned ordered logs: offsets, fetch, segments, retention, compaction, transactional visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running_total

#: Every n-th batch of a partition is in the sparse index.
INDEX_STRIDE = 4


def fetch(batches: DataFrame, offset: int, max_bytes: int, visible_end: DataFrame | None = None) -> DataFrame:
    """Whole batches from the one that holds ``offset``, per partition, until max_bytes; one at least.

    visible_end (part, end): the high-watermark, or the last stable offset for committed reads.
    """
    wanted = batches.filter(F.col("last_offset") >= offset)
    if visible_end is not None:
        wanted = wanted.join(visible_end, "part").filter(F.col("last_offset") < F.col("end")).drop("end")
    summed = running_total(wanted, ["part"], ["batch"], F.col("bytes"), "upto")
    first = wanted.groupBy("part").agg(F.min("batch").alias("first"))
    return summed.join(first, "part").filter((F.col("upto") <= max_bytes) | (F.col("batch") == F.col("first"))).drop("first", "upto")


def offsets(batches: DataFrame, durable_ends: DataFrame, min_isr: int) -> DataFrame:
    """part, log_start, high_watermark, log_end. The watermark is the min_isr-th largest replica end."""
    ends = durable_ends.groupBy("part").agg(F.element_at(F.sort_array(F.collect_list("end"), False), min_isr).alias("high_watermark"))  # one row a replica
    logs = batches.groupBy("part").agg(F.min("base_offset").alias("log_start"), (F.max("last_offset") + 1).alias("log_end"))
    return logs.join(ends, "part").select("part", "log_start", "high_watermark", "log_end")


def list_offsets(requests: DataFrame, ends: DataFrame) -> DataFrame:
    """requests (part, ts): -2 gives the log's start, -1 its end (not the watermark), anything else -1."""
    return requests.join(ends, "part").select("part", "ts", F.when(F.col("ts") == -2, F.col("log_start")).when(F.col("ts") == -1, F.col("log_end")).otherwise(F.lit(-1)).alias("offset"))


def sparse_index(batches: DataFrame, stride: int = INDEX_STRIDE) -> DataFrame:
    """Every stride-th remaining batch of each partition; ordinals count the batches that are there."""
    ordinal = running_total(batches, ["part"], ["batch"], F.lit(1), "ordinal", inclusive=False)
    return ordinal.filter(F.col("ordinal") % stride == 0).select("part", "ordinal", "base_offset", "batch")


def replica_progress(ends: DataFrame, logs: DataFrame) -> DataFrame:
    """part, replica, lag: how far a replica's end is behind the log's, never below 0."""
    return ends.join(logs.select("part", "log_end"), "part").select("part", "replica", F.greatest(F.col("log_end") - F.col("end"), F.lit(0)).alias("lag"))


def retention_candidates(segments: DataFrame, max_age: int, max_bytes: int, now: int) -> DataFrame:
    """Sealed segments that retention picks, oldest first: expired, or beyond the bytes to keep.

    A segment goes if it is expired or if it and all newer ones hold more than max_bytes, which
    equals taking the oldest until the rest fits.
    """
    newer = running_total(segments.withColumn("newest_first", -F.col("segment")), ["part"], ["newest_first"], F.col("payload_bytes"), "with_newer")
    return newer.filter((F.col("max_ts") < now - max_age) | (F.col("with_newer") > max_bytes)).drop("newest_first", "with_newer")


def log_start_after(candidates: DataFrame) -> DataFrame:
    """part, log_start: the end of the last picked segment; unpicked older ones go as well."""
    return candidates.groupBy("part").agg(F.max_by("end_offset", "segment").alias("log_start"))


def compact(records: DataFrame, now: int, grace: int, sealed_below: DataFrame) -> DataFrame:
    """part, segment, batch, base_offset, the reasons' flags and kept: what compaction leaves of a log.

    records: part, batch, segment, offset, key, value (null: tombstone), ts, control, producer
    (below 0: none), faulty (its batch can't be decoded, so its keys don't count). A sealed batch
    stays if it is opaque: faulty, or with a control record, a record of a producer or a null key;
    if a tombstone in it is younger than grace; if it is the last batch of a key, whatever record
    holds the key; or if it is its segment's first or last batch. Batches that are not sealed
    (sealed_below: part, end_segment) always stay.
    """
    keyed = records.filter("key is not null and not faulty")
    latest = keyed.groupBy("part", "key").agg(F.max("batch").alias("batch"))
    alive = latest.select("part", "batch").distinct().withColumn("is_latest", F.lit(True))
    decoded = ~F.col("faulty")
    per_batch = records.groupBy("part", "segment", "batch").agg(
        F.min("offset").alias("base_offset"),
        F.some("faulty").alias("undecodable"),
        F.some(decoded & F.col("key").isNull()).alias("null_key"),
        F.some(F.col("faulty") | F.col("control") | (F.col("producer") >= 0) | F.col("key").isNull()).alias("opaque"),
        F.some(decoded & F.col("key").isNotNull() & F.col("value").isNull() & (F.greatest(F.lit(now) - F.col("ts"), F.lit(0)) < grace)).alias("young_tombstone"),
    )
    rims = records.groupBy("part", "segment").agg(F.min("batch").alias("lo"), F.max("batch").alias("hi"))
    out = per_batch.join(alive, ["part", "batch"], "left").join(rims, ["part", "segment"]).join(sealed_below, "part")
    reasons = ["undecodable", "null_key", "opaque", "young_tombstone"]
    flags = out.select("part", "segment", "batch", "base_offset", *reasons, F.coalesce("is_latest", F.lit(False)).alias("is_latest"), ((F.col("batch") == F.col("lo")) | (F.col("batch") == F.col("hi"))).alias("rim"), (F.col("segment") < F.col("end_segment")).alias("sealed"))
    return flags.withColumn("kept", ~F.col("sealed") | F.col("opaque") | F.col("young_tombstone") | F.col("is_latest") | F.col("rim"))


def last_stable_offset(txns: DataFrame, high_watermarks: DataFrame) -> DataFrame:
    """part, lso: the first offset of the oldest ongoing transaction, else the high-watermark."""
    open_ = txns.filter("status = 'ongoing'").groupBy("part").agg(F.min("first_offset").alias("oldest"))
    return high_watermarks.join(open_, "part", "left").select("part", F.coalesce("oldest", "high_watermark").alias("lso"))


def aborted_ranges(txns: DataFrame, from_: int, through: int) -> DataFrame:
    """Aborted transactions that touch [from_, through), by first offset and producer."""
    return txns.filter((F.col("status") == "aborted") & (F.col("last_offset") >= from_) & (F.col("first_offset") < through)).select("part", "producer", "first_offset", "last_offset")


def read_committed(records: DataFrame, txns: DataFrame, lso: DataFrame, width: int = 64) -> DataFrame:
    """Records below the last stable offset that are in no aborted range of their producer.

    The interval test is an equi-join on (part, producer, offset div width), each range being
    listed once for each bucket it touches; there is no nested-loop join.
    """
    ranges = txns.filter("status = 'aborted'").select("part", "producer", F.col("first_offset").alias("lo"), F.col("last_offset").alias("hi"))
    ranges = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    visible = records.join(lso, "part").filter(F.col("offset") < F.col("lso")).drop("lso").withColumn("bucket", F.floor(F.col("offset") / width))
    hit = (visible["part"] == ranges["part"]) & (visible["producer"] == ranges["producer"]) & (visible["bucket"] == ranges["bucket"]) & (visible["offset"] >= ranges["lo"]) & (visible["offset"] <= ranges["hi"])
    return visible.join(ranges, hit, "left_anti").drop("bucket")


def last_commits(commits: DataFrame) -> DataFrame:
    """group, topic, part, offset, ts: the last commit of each consumer group wins."""
    return commits.groupBy("group", "topic", "part").agg(F.max_by("offset", F.struct("ts", "offset")).alias("offset"), F.max("ts").alias("ts"))


def fetch_offsets(requests: DataFrame, committed: DataFrame) -> DataFrame:
    """requests (group, topic, part) with the committed offset, -1 where there is none."""
    key = ["group", "topic", "part"]
    return requests.join(committed.select(*key, "offset"), key, "left").select(*key, F.coalesce("offset", F.lit(-1)).alias("offset"))


def alive_members(members: DataFrame, now: int) -> DataFrame:
    """Members heard of within their session timeout (inclusive), with the group's leader, its least member id."""
    live = members.filter(F.lit(now) - F.col("last_seen") <= F.col("session_timeout"))
    return live.withColumn("leader", F.min("member").over(Window.partitionBy("group")))


def expired_offsets(committed: DataFrame, members: DataFrame, now: int, keep: int) -> DataFrame:
    """Commits older than ``keep`` whose group has no member left."""
    return committed.join(members.select("group").distinct(), "group", "left_anti").filter(F.col("ts") + keep < now)
