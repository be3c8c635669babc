"""Lookups and guards over catalogue tables, and checks of manifests, headers, jobs and trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(requests: DataFrame, namespaces: DataFrame) -> DataFrame:
    """request, asked, id: the namespace whose id is what was asked for, else the one of that alias; null if there is none."""
    by_id = namespaces.select(F.col("id").cast("string").alias("asked"), F.col("id").alias("by_id"))
    by_alias = namespaces.select(F.col("alias").alias("asked"), F.col("id").alias("by_alias"))
    return requests.join(by_id, "asked", "left").join(by_alias, "asked", "left").select("request", "asked", F.coalesce("by_id", "by_alias").alias("id"))


def live_buckets(namespaces: DataFrame, deleted: DataFrame) -> DataFrame:
    """id, alias of the namespaces of kind bucket that aren't marked deleted."""
    return namespaces.filter("kind = 'bucket'").join(deleted.select("id"), "id", "left_anti").select("id", "alias")


def create(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """wanted (name, ..) with accepted: the name is free; of several requests for a name the first (seq) gets it."""
    first = wanted.groupBy("name").agg(F.min("seq").alias("first"))
    taken = existing.select("name").distinct().withColumn("taken", F.lit(True))
    return wanted.join(first, "name").join(taken, "name", "left").withColumn("accepted", F.col("taken").isNull() & (F.col("seq") == F.col("first"))).drop("first", "taken")


def deletable(buckets: DataFrame, objects: DataFrame, uploads: DataFrame) -> DataFrame:
    """buckets (bucket) that hold no live object and no open upload."""
    live = objects.filter("not tombstone").select("bucket")
    return buckets.join(live, "bucket", "left_anti").join(uploads.filter("status = 'open'").select("bucket"), "bucket", "left_anti")


def reconcilable(uploads: DataFrame, published: DataFrame) -> DataFrame:
    """Uploads (bucket, key, final, status) in status completing whose final content is what the key's head holds."""
    head = published.select("bucket", "key", F.col("content").alias("final"))
    return uploads.filter("status = 'completing' and final is not null").join(head, ["bucket", "key", "final"], "left_semi")


def metadata(requested: DataFrame, topics: DataFrame) -> DataFrame:
    """topic, part, leader, known for each requested topic; an unknown one has no partitions."""
    return requested.join(topics.withColumn("known", F.lit(True)), "topic", "left").select("topic", "part", "leader", F.coalesce("known", F.lit(False)).alias("known"))


def shard_health(manifests: DataFrame, inventory: DataFrame) -> DataFrame:
    """object, shards, present, health of erasure manifests (object, data, shards: array of cid): healthy, degraded while ``data`` are left, else lost."""
    placed = manifests.select("object", "data", F.posexplode("shards").alias("index", "cid")).join(inventory.select("cid").distinct().withColumn("there", F.lit(True)), "cid", "left")
    counted = placed.groupBy("object", "data").agg(F.count(F.lit(1)).alias("shards"), F.count("there").alias("present"))
    health = F.when(F.col("present") == F.col("shards"), "healthy").when(F.col("present") >= F.col("data"), "degraded").otherwise("lost")
    return counted.select("object", "shards", "present", health.alias("health"))


def erasure_faults(manifests: DataFrame) -> DataFrame:
    """object, fault of manifests (object, data, parity, stripes: array of struct<offset, length, shards>, size) that don't hold together."""
    ends = F.transform("stripes", lambda s: s["offset"] + s["length"])
    starts = F.transform("stripes", lambda s: s["offset"])
    contiguous = starts == F.concat(F.array(F.lit(0).cast("bigint")), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    fault = (
        F.when((F.col("data") < 1) | (F.col("parity") < 1) | (F.col("data") + F.col("parity") > 255), "counts")
        .when(F.size("stripes") == 0, "empty")
        .when(~contiguous, "gap")
        .when(F.element_at(ends, -1) != F.col("size"), "size")
        .when(F.exists("stripes", lambda s: s["shards"] != F.col("data") + F.col("parity")), "shards")
    )
    return manifests.select("object", fault.alias("fault")).filter("fault is not null")


def job_faults(jobs: DataFrame) -> DataFrame:
    """job, fault: inputs or outputs that are missing or repeat, a limit out of range, an entry that isn't a name."""
    several = lambda c: F.size(F.array_distinct(c)) != F.size(c)
    fault = (
        F.when(~F.regexp_like("entry", F.lit("^[a-z_][a-z0-9_]*$")), "entry")
        .when(F.size("inputs") == 0, "no inputs")
        .when(several(F.col("inputs")), "inputs repeat")
        .when(several(F.col("outputs")), "outputs repeat")
        .when((F.col("memory_mb") < 1) | (F.col("memory_mb") > 4096), "memory")
        .when((F.col("timeout_s") < 1) | (F.col("timeout_s") > 3600), "timeout")
    )
    return jobs.select("job", fault.alias("fault")).filter("fault is not null")


def database_header(header: Column, size: Column) -> Column:
    """What is wrong with the first 100 bytes of a database file of ``size`` bytes; null if nothing is.

    Fixed values of the format: 16 bytes of magic; page size at 16 (two bytes, 1 stands for
    65536); the number of pages at 28 (four bytes).
    """
    number = lambda at, n: F.conv(F.hex(F.substring(header, at + 1, n)), 16, 10).cast("bigint")
    raw = number(16, 2)
    page = F.when(raw == 1, 65536).otherwise(raw)
    sound = (page >= 512) & (page <= 65536) & (page.bitwiseAND(page - 1) == 0)
    return (
        F.when(F.length(header) < 100, "short")
        .when(F.substring(header, 1, 16) != F.unhex(F.lit("53514C69746520666F726D6174203300")), "magic")
        .when(~sound, "page size")
        .when(size % page != 0, "size")
        .when(number(28, 4) != F.floor(size / page), "pages")
    )


def tree_faults(edges: DataFrame, depths: DataFrame, most_depth: int, most_links: int) -> DataFrame:
    """node, fault of a tree's nodes. edges: parent, child; depths (node, level): what the root reaches, at the least level.

    Faults: a second parent, too many links, too deep, unreachable.
    """
    parents = edges.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("parents"))
    links = edges.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    nodes = parents.join(links, "node", "full").join(depths, "node", "left")
    fault = F.when(F.col("level").isNull(), "unreachable").when(F.col("parents") > 1, "parents").when(F.col("links") > most_links, "links").when(F.col("level") > most_depth, "depth")
    return nodes.select("node", fault.alias("fault")).filter("fault is not null")


class LinkReaders:
    """Which links a block holds, by its codec: a registry of expressions over the payload."""

    def __init__(self) -> None:
        self.readers: dict[str, Callable[[Column], Column]] = {}

    def register(self, codec: str, reader: Callable[[Column], Column]) -> None:
        """reader: payload to an array of link strings. A codec has one reader."""
        if codec in self.readers:
            raise ValueError(f"codec {codec} has a reader")
        self.readers[codec] = reader

    def links(self, blocks: DataFrame, most: int = 10_000) -> DataFrame:
        """parent, child of blocks (node, codec, payload); an unknown codec or over ``most`` links is an error."""
        found = F.raise_error(F.concat(F.lit("no reader for codec "), F.col("codec"))).cast("array<string>")
        for codec, reader in self.readers.items():
            found = F.when(F.col("codec") == codec, reader(F.col("payload"))).otherwise(found)
        checked = F.when(F.size("found") > most, F.raise_error(F.lit("too many links")).cast("array<string>")).otherwise(F.col("found"))
        return blocks.select("node", found.alias("found")).select(F.col("node").alias("parent"), F.explode(checked).alias("child"))


def sharing_ratio(written: Column, total: Column) -> Column:
    """The share of a version's nodes that an earlier one had already; 0 for an empty version."""
    return F.when(total > 0, F.greatest(total - written, F.lit(0)) / total).otherwise(F.lit(0.0))
