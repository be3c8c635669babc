"""Transactions on keyed data: preconditions, commits, diffs, rollback, retention, idempotency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIFF_LIMIT = 10_000


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("key", F.struct("cid", "value_kind").alias("a"), F.col("generation").alias("a_generation"))
    right = b.select("key", F.struct("cid", "value_kind").alias("b"), F.col("generation").alias("b_generation"))
    return left.join(right, "key", "full")


def _change() -> Column:
    return F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified").alias("change")


def diff(a: DataFrame, b: DataFrame, limit: int | None = DIFF_LIMIT) -> DataFrame:
    """key, change from snapshot a to b; values include the generation. The first ``limit`` keys, None for all."""
    changed = _sides(a, b).filter(~(F.col("a").eqNullSafe(F.col("b")) & F.col("a_generation").eqNullSafe(F.col("b_generation")))).select("key", _change())
    return changed if limit is None else changed.orderBy("key").limit(limit)


def logical_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, change, the target's cid and value_kind; the generation doesn't count."""
    return _sides(a, b).filter(~F.col("a").eqNullSafe(F.col("b"))).select("key", _change(), "b.cid", "b.value_kind")


def rollback(head: DataFrame, target: DataFrame) -> DataFrame:
    """The mutations of a new revision that restores target: generations go on from the head's."""
    d = logical_diff(head, target).join(head.select("key", "generation"), "key", "left")
    return d.select("key", F.when(F.col("change") == "removed", "delete").otherwise("put").alias("op"), "cid", "value_kind", F.when(F.col("change") != "removed", F.coalesce("generation", F.lit(0)) + 1).alias("generation"))


def precondition_holds(kind: Column, current_generation: Column, current_cid: Column, want_generation: Column, want_cid: Column) -> Column:
    """absent: no current value; match: the same generation and cid; any: true."""
    return F.when(kind == "absent", current_generation.isNull()).when(kind == "match", current_generation.eqNullSafe(want_generation) & current_cid.eqNullSafe(want_cid)).otherwise(F.lit(True))


def apply_transactions(head: DataFrame, mutations: DataFrame) -> DataFrame:
    """mutations: txn, key, op (assert, put, delete), cid, pre, pre_generation, pre_cid, one txn a key.

    Adds holds (the key's precondition), applied (all of the transaction's hold and it is not
    all asserts) and new_generation (1, or the key's next; null unless a put is applied).
    """
    joined = mutations.join(head.select("key", F.col("generation").alias("cur_generation"), F.col("cid").alias("cur_cid")), "key", "left")
    checked = joined.withColumn("holds", precondition_holds(F.col("pre"), F.col("cur_generation"), F.col("cur_cid"), F.col("pre_generation"), F.col("pre_cid")))
    verdict = checked.groupBy("txn").agg(F.every("holds").alias("all_hold"), F.some(F.col("op") != "assert").alias("writes"))
    out = checked.join(verdict, "txn").withColumn("applied", F.col("all_hold") & F.col("writes"))
    return out.withColumn("new_generation", F.when(F.col("applied") & (F.col("op") == "put"), F.coalesce("cur_generation", F.lit(0)) + 1)).drop("all_hold", "writes", "cur_cid")


def commit_times(commits: DataFrame) -> DataFrame:
    """Adds committed_ts: client times clamped so that they never go back within a namespace.

    A running maximum in two levels, as the prefix sums: per range of revisions, then inside one.
    """
    ranged = commits.withColumn("_range", F.floor(F.col("revision") / 4096))
    tops = ranged.groupBy("namespace", "_range").agg(F.max("client_ts").alias("_top"))
    before = Window.partitionBy("namespace").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_before", F.max("_top").over(before)).drop("_top")
    within = Window.partitionBy("namespace", "_range").orderBy("revision").rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(tops, ["namespace", "_range"]).withColumn("committed_ts", F.greatest(F.max("client_ts").over(within), "_before")).drop("_range", "_before")


def retained(revisions: DataFrame, keep_last: int, max_age: int, named: DataFrame | None = None) -> DataFrame:
    """revisions (namespace, revision, committed_at) that are protected: among the last, young enough, or named.

    Ages count from the namespace's newest commit. The keep_last newest revisions come from a
    ranking that Spark cuts before the shuffle.
    """
    newest = revisions.groupBy("namespace").agg(F.max("committed_at").alias("newest"))
    rank = F.row_number().over(Window.partitionBy("namespace").orderBy(F.desc("revision")))
    last = revisions.withColumn("rank", rank).filter(F.col("rank") <= keep_last).select("namespace", "revision").withColumn("last", F.lit(True))
    out = revisions.join(newest, "namespace").join(last, ["namespace", "revision"], "left")
    keep = F.col("last").isNotNull() | (F.col("committed_at") >= F.col("newest") - max_age)
    if named is not None:
        out = out.join(named.select("namespace", "revision").distinct().withColumn("named", F.lit(True)), ["namespace", "revision"], "left")
        keep = keep | F.col("named").isNotNull()
    return out.filter(keep).select("namespace", "revision", "committed_at")


def pin_intents(before: DataFrame, after: DataFrame) -> DataFrame:
    """namespace, revision, intent: what came under protection and what lost it."""
    key = ["namespace", "revision"]
    return after.join(before, key, "left_anti").select(*key, F.lit("protect").alias("intent")).union(before.join(after, key, "left_anti").select(*key, F.lit("release").alias("intent")))


def idempotent(requests: DataFrame, known: DataFrame) -> DataFrame:
    """requests (request_id, fingerprint) with outcome: new, replay (same intent) or conflict."""
    joined = requests.join(known.select("request_id", F.col("fingerprint").alias("known")), "request_id", "left")
    return joined.withColumn("outcome", F.when(F.col("known").isNull(), "new").when(F.col("known") == F.col("fingerprint"), "replay").otherwise("conflict")).drop("known")


def newest_records(records: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest records of each namespace by (revision, request_id); older ones are pruned."""
    rank = F.row_number().over(Window.partitionBy("namespace").orderBy(F.desc("revision"), F.desc("request_id")))
    return records.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")


def create_named(snapshots: DataFrame, wanted: DataFrame, head: int) -> DataFrame:
    """wanted (name, revision or null) with accepted: the name is free and the revision (head by default) exists."""
    taken = snapshots.select("name").distinct().withColumn("taken", F.lit(True))
    return wanted.join(taken, "name", "left").select("name", F.coalesce("revision", F.lit(head)).alias("revision"), (F.col("taken").isNull() & (F.coalesce("revision", F.lit(head)) <= head)).alias("accepted"))
