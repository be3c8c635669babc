"""Versioned keyed data: snapshots, point, bulk and range reads, keyset pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Entries of a page at most.
MOST_ENTRIES = 10_000


def snapshot(changes: DataFrame, revision: int | None = None) -> DataFrame:
    """key, cid, value_kind, generation, revision of the live keys at a revision (the head by default).

    generation counts the puts since the key's last delete. Two aggregates with map-side
    combine and a join of one row per key: no window gathers a key's history in one task.
    """
    at = changes if revision is None else changes.filter(F.col("revision") <= revision)
    deleted = at.filter("op = 'delete'").groupBy("key").agg(F.max("revision").alias("gone"))
    puts = at.filter("op = 'put'").join(deleted, "key", "left").filter(F.col("revision") > F.coalesce("gone", F.lit(0)))
    last = F.max_by(F.struct("cid", "value_kind"), "revision").alias("v")
    return puts.groupBy("key").agg(last, F.count(F.lit(1)).alias("generation"), F.max("revision").alias("revision")).select("key", "v.cid", "v.value_kind", "generation", "revision")


def get(live: DataFrame, key: str) -> DataFrame:
    return live.filter(F.col("key") == key)


def get_many(live: DataFrame, keys: list[str]) -> DataFrame:
    """One row per asked key, in the caller's order (pos), duplicates kept; nulls where the key is absent."""
    if len(keys) > MOST_ENTRIES:
        raise ValueError(f"at most {MOST_ENTRIES} keys a read")
    asked = live.sparkSession.createDataFrame([Row(pos=i, key=k) for i, k in enumerate(keys)], "pos int, key string")
    return F.broadcast(asked).join(live.filter(F.col("key").isin(list(set(keys)))), "key", "left")


def scan(live: DataFrame, start: str | None = None, end: str | None = None, prefix: str | None = None, after: str | None = None, limit: int = MOST_ENTRIES) -> DataFrame:
    """A page in key order: start inclusive, end exclusive, after exclusive; has_more tells of a next page.

    Keys compare bytewise. The page is a top-k (limit + 1 rows a task reach the driver), so
    its size, not the table's, bounds the last step.
    """
    if not 1 <= limit <= MOST_ENTRIES:
        raise ValueError(f"limit is 1 to {MOST_ENTRIES}")
    page = live
    for bound, keep in ((start, lambda b: F.col("key") >= b), (end, lambda b: F.col("key") < b), (after, lambda b: F.col("key") > b), (prefix, lambda b: F.col("key").startswith(b))):
        if bound is not None:
            page = page.filter(keep(bound))
    ahead = page.orderBy("key").limit(limit + 1)
    numbered = ahead.agg(F.array_sort(F.collect_list(F.struct(*[F.col("key"), *[c for c in page.columns if c != "key"]]))).alias("e"))
    return numbered.select(F.explode(F.slice("e", 1, limit)).alias("e"), (F.size("e") > limit).alias("has_more")).select("e.*", "has_more")


def read_your_writes(live: DataFrame, pending: DataFrame) -> DataFrame:
    """live with a transaction's own writes on top. pending: key, op, cid, value_kind."""
    written = pending.select("key", "op", F.col("cid").alias("new_cid"), F.col("value_kind").alias("new_kind"))
    both = live.join(written, "key", "full")
    return both.filter("op is null or op = 'put'").select("key", F.coalesce("new_cid", "cid").alias("cid"), F.coalesce("new_kind", "value_kind").alias("value_kind"), F.col("op").isNotNull().alias("pending"))
