"""Operator 2, mixing sources to target weights, with built-in functions only.

Weighted fair queueing: within its source, in a shuffled order, each document's virtual
finish time is the cumulative count of words divided by the source's target. All documents
are then ordered by finish time and the order is cut where the budget is spent.

No window sees a whole source or the whole table. Prefix sums are taken in two levels: a
total per range of the order (a small table, one row per ``rows_per_range`` documents), and
a window inside each range. A source with a third of all rows has a third of the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, checkpointed, packed, unpacked, whole_text, written

#: Fixed values of the mix: source weights in turn, budget as a share of all words, copies at most.
WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
_SPAN = 1 << 60


def source_targets(sources: DataFrame) -> DataFrame:
    """sources: sk, source_size. Adds target: the weighted share of the budget, water-filled.

    A source is full at MAX_EPOCHS times its size. In order of cap over weight, ``level`` is what
    each unit of weight gets if all sources before are full: it rises while the next source is
    full below it and falls after, so the highest level is the one that holds.
    """
    by_key, by_fill, full = Window.orderBy("sk"), Window.orderBy("fill", "sk"), Window.partitionBy()
    w = sources.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), ((F.row_number().over(by_key) - 1) % len(WEIGHTS) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * MAX_EPOCHS).withColumn("fill", F.col("cap").cast("double") / F.col("w"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(full) * F.lit(BUDGET_SHARE) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(full) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    w = w.withColumn("level", level.cast("double"))
    return w.select("sk", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.max("level").over(full)).alias("target"))


def _keyed(doc_id: str, text: str, source: str) -> dict[str, Column]:
    """The columns that place a row in its source's order; rows that agree in all of them are alike."""
    size = F.regexp_count(whole_text(text), F.lit(WORD_CLASS)).cast("bigint")
    sk = F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))
    shuffled = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("?"), whole_text(text)))  # rows without an id are shuffled by their text
    u = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), shuffled)), 1, 15), 16, 10).cast("bigint")
    return {"sk": sk, "u": u, "size": size}


def _taken(docs: DataFrame, doc_id: str, text: str, source: str, rows_per_range: int) -> DataFrame:
    """doc_id, sk, u, size, source_size, target, copies (how many times the mix takes the row): one row per input row."""
    rows = checkpointed(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), *[c.alias(n) for n, c in _keyed(doc_id, text, source).items()]))
    ranges = rows.count() // rows_per_range + 1
    rows = rows.withColumn("range", F.floor(F.col("u") / F.lit(-(-_SPAN // ranges))).cast("bigint"))

    sources = source_targets(rows.groupBy("sk").agg(F.sum("size").alias("source_size")))
    totals = rows.groupBy("sk", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("sk").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0))).join(sources, "sk").drop("range_size")

    within = Window.partitionBy("sk", "range").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    timed = rows.join(offsets, ["sk", "range"]).withColumn("done", F.col("before") + F.sum("size").over(within))
    timed = checkpointed(timed.select("doc_id", "sk", "u", "size", "source_size", "target", *[F.when(F.col("target") > 0, (F.col("done") + e * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0)).alias(f"finish{e}") for e in range(MAX_EPOCHS)]))

    last = _cut(timed, ranges // 10 + 1)
    place = lambda e: F.struct(F.col(f"finish{e}"), "u", "doc_id", "sk", F.lit(e))
    copies = sum((place(e) <= F.struct(*last)).cast("bigint") for e in range(MAX_EPOCHS)) if last else F.lit(0)
    return timed.select("doc_id", "sk", "u", "size", "source_size", "target", copies.cast("bigint").alias("copies"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", rows_per_range: int = 2_000) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words, repeats counted).

    * null text: size 0, nothing taken. null source: a source of its own, last in order.
    * rows that repeat an id are separate documents; ties fall to the shuffled key, then the id.
    * null doc_id: the row is shuffled by its text.
    * no rows, or no words at all: every taken is 0. Other columns of the input are not read.
    """
    return _taken(docs, doc_id, text, source, rows_per_range).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", rows_per_range: int = 2_000) -> DataFrame:
    """The mix itself: each row of docs, with all its columns, as often as ``mix_sources`` takes it.

    Rows find their copies by what places them in their source's order, so null and repeated
    ids lose nothing. Of rows alike in that, where the mix takes some more often than others,
    any are the ones: their id, source and size are the same. Rows without words are not taken.
    """
    key = ["sk", "u", "id", "size"]
    id_ = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias("id")  # noqa: E731  (rows without one have a u of their own)
    takes = _taken(docs, doc_id, text, source, rows_per_range).filter("size > 0")
    takes = written(takes.groupBy("sk", "u", id_("doc_id"), "size").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike")).filter("copies > 0"))
    rows = docs.select(packed(docs).alias("row"), id_(doc_id), *[c.alias(n) for n, c in _keyed(doc_id, text, source).items()]).join(takes, key)
    times = F.floor(F.col("copies") / F.col("alike"))
    if not takes.filter("copies % alike <> 0").isEmpty():
        turn = F.row_number().over(Window.partitionBy(*key).orderBy("copies"))
        rows = rows.withColumn("turn", turn)
        times = times + (F.col("turn") <= F.col("copies") % F.col("alike")).cast("bigint")
    rows = rows.withColumn("times", times).filter("times > 0")
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select(*unpacked(docs.columns))


def _cut(timed: DataFrame, slots_per_unit: int) -> list | None:
    """The place of the last copy within the budget, as literals; None if there is none."""
    epochs = timed.select("doc_id", "u", "sk", "size", F.posexplode(F.array(*[F.col(f"finish{e}") for e in range(MAX_EPOCHS)])).alias("epoch", "finish"))
    epochs = epochs.withColumn("slot", F.floor(F.col("finish") * slots_per_unit).cast("bigint"))
    budget = F.lit(BUDGET_SHARE)
    slots = epochs.groupBy("slot").agg(F.sum("size").alias("slot_size"), F.sum(F.when(F.col("epoch") == 0, F.col("size")).otherwise(0)).alias("words"))
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = slots.withColumn("after", F.sum("slot_size").over(upto)).withColumn("budget", F.sum("words").over(Window.partitionBy()) * budget)
    cut = slots.agg(F.min(F.when(F.col("after") > F.col("budget"), F.struct("slot", (F.col("after") - F.col("slot_size")).alias("before"), "budget"))).alias("c")).first()["c"]
    at = epochs if cut is None else epochs.filter(F.col("slot") <= F.lit(cut["slot"]))
    place = F.struct("finish", "u", "doc_id", "sk", "epoch")
    if cut is not None:
        inside = epochs.filter(F.col("slot") == F.lit(cut["slot"])).withColumn("upto", F.lit(cut["before"]) + F.sum("size").over(Window.partitionBy("slot").orderBy("finish", "u", "doc_id", "sk", "epoch").rowsBetween(Window.unboundedPreceding, 0)))
        found = inside.filter(F.col("upto") <= F.lit(float(cut["budget"]))).agg(F.max(place).alias("p")).first()["p"]
        if found is not None:
            return _literals(found)
        at = epochs.filter(F.col("slot") < F.lit(cut["slot"]))
    found = at.agg(F.max(place).alias("p")).first()["p"]
    return None if found is None else _literals(found)


def _literals(place) -> list:
    return [F.lit(x).cast(kind) for x, kind in zip(place, ("double", "bigint", "bigint", "string", "int"))]


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, coalesce('0' || source, '1') AS sk,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '?' || coalesce(text, ''))), 1, 15) AS BIGINT) AS u
  FROM documents),
s0 AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY sk),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY sk) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
              2 * source_size AS cap FROM s0),
s2 AS (SELECT *, CAST(cap AS DOUBLE) / w AS fill FROM s1),
s3 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
                  - CAST(coalesce(sum(cap) OVER (ORDER BY fill, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
                 / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY fill, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
       FROM s2),
s5 AS (SELECT sk, source_size, least(CAST(cap AS DOUBLE), w * max(level) OVER ()) AS target FROM s3),
t AS (SELECT r.*, source_size, target,
             CAST(sum(size) OVER (PARTITION BY sk ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done
      FROM rows r JOIN s5 USING (sk)),
e AS (SELECT t.*, epoch, CASE WHEN target > 0 THEN CAST(done + epoch * source_size AS DOUBLE) / target ELSE 0.0 END AS finish
      FROM t, (VALUES (0), (1)) x(epoch)),
q AS (SELECT *, sum(size) OVER (ORDER BY finish, u, doc_id, sk, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT doc_id, size, source_size, target,
       CAST(sum(CASE WHEN upto <= 1.5 * (SELECT sum(size) FROM rows) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM q GROUP BY doc_id, size, source_size, target
"""
