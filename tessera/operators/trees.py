"""File trees: directory closure, flattening, diffs, counters and guarded mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parent(path):
    return F.regexp_replace(path, r"/?[^/]*$", "")


def with_ancestors(files: DataFrame) -> DataFrame:
    """path, kind, size, files' own rows and each ancestor directory once. files: path, size."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = files.filter(F.size(parts) > 1).select(F.explode(prefixes).alias("path")).distinct()
    own = files.groupBy("path").agg(F.max("size").alias("size"))
    return own.join(dirs, "path", "left_anti").select("path", F.lit("file").alias("kind"), "size").union(dirs.select("path", F.lit("dir"), F.lit(0).cast("bigint")))


def missing_parents(entries: DataFrame) -> DataFrame:
    """Entries whose parent is no listed directory; top-level entries have the root."""
    dirs = entries.filter("kind = 'dir'").select(F.col("path").alias("parent"))
    return entries.withColumn("parent", parent(F.col("path"))).filter("parent <> ''").join(dirs, "parent", "left_anti").select("path", "kind", "size")


def counters(entries: DataFrame) -> DataFrame:
    """file_count, directory_count (the root counts) and logical_bytes."""
    return entries.agg(F.count_if(F.col("kind") == "file").alias("file_count"), (F.count_if(F.col("kind") == "dir") + 1).alias("directory_count"), F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("size"))), F.lit(0)).alias("logical_bytes"))


def subtree(entries: DataFrame, root: str) -> DataFrame:
    """The entries below a directory, by path: a prefix read, which needs no recursion."""
    return entries.filter(F.col("path").startswith(root + "/"))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, change: added, removed or modified (kind or size differ)."""
    a = left.select("path", F.struct("kind", "size").alias("a"))
    b = right.select("path", F.struct("kind", "size").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
    return a.join(b, "path", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("path", change.alias("change"))


def directory_sizes(entries: DataFrame) -> DataFrame:
    """path, files, bytes of each directory with everything below it."""
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir")
    return entries.filter((F.col("kind") == "file") & (F.size(parts) > 1)).select(above, "size").groupBy(F.col("dir").alias("path")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def refused_deletes(entries: DataFrame, deletes: DataFrame) -> DataFrame:
    """Deletes (path) that a tree refuses: the path is missing, or a directory keeps a child that is not deleted too."""
    kept = entries.join(deletes, "path", "left_anti").select(parent(F.col("path")).alias("path")).distinct().withColumn("has_child", F.lit(True))
    found = deletes.join(entries.select("path", "kind"), "path", "left").join(kept, "path", "left")
    reason = F.when(F.col("kind").isNull(), "missing").when((F.col("kind") == "dir") & F.col("has_child").isNotNull(), "not empty")
    return found.select("path", reason.alias("reason")).filter("reason is not null")
