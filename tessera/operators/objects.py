"""Content-addressed blocks and objects: chunks, manifests, byte ranges, listings, multipart uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import POINTS, common_prefix, hash_point

LIST_LIMIT = 1_000
MOST_PARTS = 10_000


def chunks(objects: DataFrame, chunk: int) -> DataFrame:
    """object, offset, size, digest, payload of each object's content (a string), cut at ``chunk`` characters."""
    size = F.length("content")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(chunk))).alias("offset")
    cut = objects.filter(size > 0).select("object", "content", starts).select("object", "offset", F.substring("content", F.col("offset") + 1, F.lit(chunk)).alias("payload"))
    return cut.select("object", F.col("offset").cast("bigint").alias("offset"), F.length("payload").cast("bigint").alias("size"), F.sha2("payload", 256).alias("digest"), "payload")


def assemble(parts: DataFrame) -> DataFrame:
    """object, content: each object's chunks joined in order. An object's chunks fit a row, as the object does."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "payload")))
    return parts.groupBy("object").agg(F.array_join(F.transform(ordered, lambda c: c["payload"]), "").alias("content"))


def range_chunks(manifest: DataFrame, first: Column, last: Column) -> DataFrame:
    """Chunks that overlap [first, last], with the part of each: from_ and until, within the chunk."""
    hit = (F.col("offset") <= last) & (F.col("offset") + F.col("size") > first)
    return manifest.filter(hit).withColumns({"from_": F.greatest(first - F.col("offset"), F.lit(0)), "until": F.least(last - F.col("offset") + 1, F.col("size"))})


def range_body(manifest: DataFrame, first: Column, last: Column) -> DataFrame:
    """object, body: the bytes of the range, joined in order."""
    cut = range_chunks(manifest, first, last).withColumn("payload", F.substring("payload", F.col("from_") + 1, F.col("until") - F.col("from_")))
    return assemble(cut).withColumnRenamed("content", "body")


def put_blocks(blocks: DataFrame, stored: DataFrame) -> DataFrame:
    """One row a distinct digest: digest, id (the least), copies, already_existed. blocks: id, digest."""
    new = blocks.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    known = stored.select("digest").distinct().withColumn("known", F.lit(True))
    return new.join(known, "digest", "left").select("digest", "id", "copies", F.col("known").isNotNull().alias("already_existed"))


def manifest_faults(manifest: DataFrame, sizes: DataFrame) -> DataFrame:
    """Objects whose chunks leave a gap, overlap, are empty or don't add up to the size. sizes: object, total."""
    at = Window.partitionBy("object").orderBy("offset")
    expected = F.coalesce(F.lag(F.col("offset") + F.col("size")).over(at), F.lit(0))
    checked = manifest.withColumn("bad", (F.col("offset") != expected) | (F.col("size") <= 0))
    ends = checked.groupBy("object").agg(F.count_if("bad").alias("bad_chunks"), F.max(F.col("offset") + F.col("size")).alias("end"))
    return ends.join(sizes, "object").filter((F.col("bad_chunks") > 0) | (F.col("end") != F.col("total"))).select("object", "bad_chunks", (F.col("end") != F.col("total")).alias("wrong_size"))


def corrupt(blocks: DataFrame) -> DataFrame:
    """Blocks whose payload doesn't hash to their digest."""
    return blocks.filter(F.sha2("payload", 256) != F.col("digest"))


def block_page(blocks: DataFrame, after: str, limit: int) -> DataFrame:
    """A keyset page of the block inventory, with the integrity state."""
    state = F.when(F.col("corrupt"), "corrupt").when(~F.col("present"), "missing").otherwise("healthy")
    return blocks.filter(F.col("digest") > after).orderBy("digest").limit(limit).select("digest", "size", state.alias("integrity_state"))


def list_objects(keys: DataFrame, prefix: str = "", delimiter: str | None = None, start_after: str | None = None, max_keys: int = LIST_LIMIT) -> DataFrame:
    """A listing page: entry, is_prefix, size, truncated. keys: key, size, tombstone.

    Keys with the delimiter after the prefix roll up to one entry; entries after start_after,
    in order; truncated is set as soon as the page is full, as the listing protocol has it.
    """
    if max_keys == 0:
        return keys.limit(0).select(F.col("key").alias("entry"), F.lit(False).alias("is_prefix"), "size", F.lit(False).alias("truncated"))
    live = keys.filter(~F.col("tombstone") & F.col("key").startswith(prefix))
    if start_after is not None:
        live = live.filter(F.col("key") > start_after)
    rolled = common_prefix(F.col("key"), prefix, delimiter)
    entries = live.select(F.coalesce(rolled, "key").alias("entry"), rolled.isNotNull().alias("is_prefix"), F.when(rolled.isNull(), F.col("size")).alias("size"))
    page = entries.groupBy("entry", "is_prefix").agg(F.max("size").alias("size"))
    if start_after is not None:
        page = page.filter(F.col("entry") > start_after)
    page = page.orderBy("entry").limit(min(max_keys, LIST_LIMIT))
    full = page.agg(F.collect_list(F.struct("entry", "is_prefix", "size")).alias("e"))
    return full.select(F.explode("e").alias("e"), (F.size("e") >= min(max_keys, LIST_LIMIT)).alias("truncated")).select("e.*", "truncated")


def bucket_page(keys: DataFrame, prefix: str, limit: int) -> DataFrame:
    """The first ``limit`` keys with the prefix; tombstones go after the limit, so a page may be short."""
    return keys.filter(F.col("key").startswith(prefix)).orderBy("key").limit(limit).filter(~F.col("tombstone"))


def partition_faults(partitions: DataFrame) -> DataFrame:
    """Partitions (partition_id, hash_start, hash_end) that leave a gap or overlap, or miss the ends of the hash space.

    At most 256 rows; the whole map is checked in one task.
    """
    at = Window.orderBy("hash_start")
    prev = F.coalesce(F.lag("hash_end").over(at), F.lit(0))
    last = F.lead("hash_start").over(at).isNull() & (F.col("hash_end") != POINTS)
    return partitions.withColumn("bad", (F.col("hash_start") != prev) | (F.col("hash_end") <= F.col("hash_start")) | last).filter("bad").drop("bad")


def route(keys: DataFrame, partitions: DataFrame) -> DataFrame:
    """keys with point and partition_id. Partition bounds are multiples of 256 points, so the range join is an equi-join."""
    owners = partitions.withColumn("slot", F.explode(F.sequence(F.floor(F.col("hash_start") / 256), F.floor((F.col("hash_end") - 1) / 256))))
    pointed = keys.withColumn("point", hash_point(F.col("key"))).withColumn("slot", F.floor(F.col("point") / 256))
    return pointed.join(F.broadcast(owners.select("slot", "partition_id")), "slot").drop("slot")  # 256 rows at most


def complete_upload(asked: DataFrame, stored: DataFrame, least: int) -> DataFrame:
    """upload, accepted, parts, size, reason. asked: upload, pos, part, etag; stored: upload, part, etag, size.

    Parts must ascend, exist with that etag, and be ``least`` long but for the last.
    """
    at = Window.partitionBy("upload").orderBy("pos")
    joined = asked.withColumn("ascending", F.coalesce(F.lag("part").over(at) < F.col("part"), F.lit(True))).withColumn("is_last", F.lead("part").over(at).isNull())
    joined = joined.join(stored.select("upload", "part", F.col("etag").alias("stored_etag"), "size"), ["upload", "part"], "left")
    per = joined.groupBy("upload").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size"), F.every("ascending").alias("ascending"),
        F.every(F.coalesce(F.col("stored_etag") == F.col("etag"), F.lit(False))).alias("found"), F.every(F.col("is_last") | (F.coalesce("size", F.lit(0)) >= least)).alias("long_enough"))
    reason = F.when(~F.col("ascending"), "order").when(~F.col("found"), "part").when(~F.col("long_enough"), "size").when(F.col("parts") > MOST_PARTS, "count")
    return per.select("upload", reason.isNull().alias("accepted"), "parts", F.when(reason.isNull(), F.col("size")).alias("size"), reason.alias("reason"))


def read_slices(slices: DataFrame, packs: DataFrame) -> DataFrame:
    """output_index, payload, intact: each slice cut from its pack, which is read once. slices: output_index, pack, offset, length, digest."""
    cut = slices.join(packs, "pack").withColumn("payload", F.substring("content", F.col("offset") + 1, F.col("length")))
    return cut.select("output_index", "payload", (F.sha2("payload", 256) == F.col("digest")).alias("intact"))


def compaction_candidates(extents: DataFrame, percent: int) -> DataFrame:
    """Extents (extent, live_bytes, total_bytes) whose dead share reaches the threshold, most dead bytes first."""
    dead = F.col("total_bytes") - F.col("live_bytes")
    return extents.withColumn("dead_bytes", dead).filter(dead * 100 >= F.col("total_bytes") * percent).orderBy(F.desc("dead_bytes"), "extent")


def stale_uploads(uploads: DataFrame, days: Column, now: int) -> DataFrame:
    """Open uploads that a lifecycle rule ends: started ``days`` days ago or before."""
    return uploads.filter((F.col("status") == "open") & (F.col("initiated") <= F.lit(now) - days * 86_400))
