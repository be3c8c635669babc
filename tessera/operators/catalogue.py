"""Catalogue tables: topics, buckets, leases, pins, groups, uploads, pages and their guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import ordered_fold


def create_topics(wanted: DataFrame, existing: DataFrame, brokers: list[int]) -> DataFrame:
    """topic, part, replicas, leader of the accepted topics; replica j of partition p is broker (p + j) mod n.

    wanted: topic, partitions, replication, min_isr. Refused: a taken name, more replicas than
    brokers, more in-sync replicas than replicas.
    """
    ok = wanted.join(existing.select("topic"), "topic", "left_anti").filter((F.col("partitions") > 0) & (F.col("replication") <= len(brokers)) & (F.col("min_isr") <= F.col("replication")))
    parts = ok.select("topic", "replication", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("part"))
    ids = F.array(*map(F.lit, brokers))
    replicas = F.transform(F.sequence(F.lit(0), F.col("replication") - 1), lambda j: F.element_at(ids, (F.pmod(F.col("part") + j, F.lit(len(brokers))) + 1).cast("int")))
    return parts.select("topic", "part", replicas.alias("replicas")).withColumn("leader", F.element_at("replicas", 1))


def alter_configs(current: DataFrame, changes: DataFrame) -> DataFrame:
    """topic, name, value: changes (value null: removed) on top of current entries."""
    both = current.select("topic", "name", F.col("value").alias("old")).join(changes.select("topic", "name", F.col("value").alias("new"), F.lit(True).alias("changed")), ["topic", "name"], "full")
    return both.select("topic", "name", F.when(F.col("changed"), F.col("new")).otherwise(F.col("old")).alias("value")).filter("value is not null")


def shard(key: Column, n: int) -> Column:
    """A key's coordinator shard: the first 8 hex digits of its digest modulo n."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def active(leases: DataFrame, now: int) -> DataFrame:
    """Active rows whose expiry is null or later than now."""
    return leases.filter((F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def roots(pins: DataFrame, leases: DataFrame, intents: DataFrame, now: int) -> DataFrame:
    """The distinct roots that stand: active pins and leases, and intents to protect that aren't released."""
    return active(pins, now).select("root").union(active(leases, now).select("root")).union(intents.filter("kind = 'protect' and status in ('pending', 'applied')").select("root")).distinct()


def keyset_page(rows: DataFrame, order: list[str], after: tuple, limit: int) -> DataFrame:
    """The first ``limit`` rows beyond a marker over several columns, compared as a tuple."""
    beyond = F.struct(*order) > F.struct(*[F.lit(v).cast(dict(rows.dtypes)[c]).alias(c) for c, v in zip(order, after)])
    return rows.filter(beyond).orderBy(*order).limit(limit)


def duplicate_ownership(assignments: DataFrame) -> DataFrame:
    """group, topic, part, owners of partitions that more than one member of a group holds."""
    return assignments.groupBy("group", "topic", "part").agg(F.count_distinct("member").alias("owners")).filter("owners > 1")


def unsorted(rows: DataFrame, group: str, position: str, key: str) -> DataFrame:
    """Rows whose key isn't above the one before in their list: lists must be strictly sorted."""
    at = Window.partitionBy(group).orderBy(position)
    return rows.withColumn("previous", F.lag(key).over(at)).filter(F.col("previous") >= F.col(key))


def incomplete(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """db, pages, expected of page tables that aren't dense from 1. pages: db, page; counts: db, expected."""
    seen = pages.groupBy("db").agg(F.count_distinct("page").alias("pages"), F.min("page").alias("low"), F.max("page").alias("high"))
    dense = (F.col("pages") == F.col("expected")) & (F.col("low") == 1) & (F.col("high") == F.col("expected"))
    return counts.join(seen, "db", "left").filter(~F.coalesce(dense, F.lit(False))).select("db", F.coalesce("pages", F.lit(0)).alias("pages"), "expected")


def truncate(pages: DataFrame, last: Column) -> DataFrame:
    return pages.filter(F.col("page") <= last)


def put_versions(head: DataFrame, puts: DataFrame) -> DataFrame:
    """The head of a bucket after puts and deletes (tombstones), each linked to the version before.

    head: key, version, tombstone. puts: key, version, if_none (the key must have no live version), tombstone.
    """
    joined = puts.join(head.select("key", F.col("version").alias("previous"), F.col("tombstone").alias("was_gone")), "key", "left")
    live = F.col("previous").isNotNull() & ~F.col("was_gone")
    return joined.select("key", "version", "previous", "tombstone", (~(F.col("if_none") & live) & ~(F.col("tombstone") & ~live)).alias("accepted"))


def pack(pending: DataFrame, most: int) -> DataFrame:
    """extent, key, offset, size: pending objects packed in key order, a new extent each ``most`` bytes.

    An object starts a new extent if it doesn't fit the open one, so each choice depends on
    the one before: a fold within each namespace.
    """

    class Extent:
        def __init__(self) -> None:
            self.number, self.used = 0, 0

    def step(e: Extent, row) -> dict:
        if e.used and e.used + row.size > most:
            e.number, e.used = e.number + 1, 0
        at = e.used
        e.used += row.size
        return {"key": row.key, "extent": e.number, "offset": at, "size": row.size}

    return ordered_fold(pending, ["namespace"], ["key"], Extent, step, "namespace string, key bigint, extent bigint, offset bigint, size bigint")


def fetch_request(wanted: DataFrame, batches: DataFrame) -> DataFrame:
    """request, part, batch of a fetch whose byte budget its partitions share in order; each gives one batch at least.

    wanted: request, pos, part, offset, max_bytes.
    """
    asked = wanted.join(batches, "part").filter(F.col("last_offset") >= F.col("offset"))

    class Budget:
        def __init__(self) -> None:
            self.left, self.pos, self.open = None, None, False

    def step(b: Budget, row) -> dict:
        if b.left is None:
            b.left = row.max_bytes
        fresh = row.pos != b.pos
        if fresh:
            b.pos, b.open = row.pos, True
        taken = b.open and (fresh or row.bytes <= b.left)
        b.open = taken
        if taken:
            b.left = max(0, b.left - row.bytes)
        return {"part": row.part, "batch": row.batch, "taken": bool(taken)}

    return ordered_fold(asked, ["request"], ["pos", "batch"], Budget, step, "request bigint, part bigint, batch bigint, taken boolean").filter("taken").drop("taken")


def run_job(inputs: DataFrame, function, schema: str) -> DataFrame:
    """A user's function over batches of inputs (pandas frames in, pandas frames out), where the data lie."""
    return inputs.mapInPandas(function, schema)


def cost_matrix(operations: DataFrame, workload: str, metric: str, value: str, metrics: list) -> DataFrame:
    """One row a workload, one column a metric, the sum of values."""
    return operations.groupBy(workload).pivot(metric, metrics).agg(F.sum(value))


def parse_uri(uri: Column, known: tuple[str, ...] = ("mode", "snapshot", "busy_timeout_ms")) -> Column:
    """struct<database, mode, snapshot, busy_timeout_ms> of ``tessera:name?k=v&..``; null if a key is unknown or repeats."""
    query = F.coalesce(F.regexp_extract(uri, r"\?(.*)$", 1), F.lit(""))
    names = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    sound = (F.size(F.array_except(names, F.array(*map(F.lit, known)))) == 0) & (F.size(F.array_distinct(names)) == F.size(names)) & uri.rlike(r"^tessera:[^?/]+(\?.*)?$")
    part = lambda k: F.nullif(F.regexp_extract(query, rf"(?:^|&){k}=([^&]*)", 1), F.lit("")).alias(k)
    return F.when(sound, F.struct(F.regexp_extract(uri, r"^tessera:([^?/]+)", 1).alias("database"), *map(part, known)))
