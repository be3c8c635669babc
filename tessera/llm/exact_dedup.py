"""Operator 1, exact deduplication, with built-in functions only.

Rows are grouped by a 128-bit hash of the normalised text *and* by the text's bytes, so two
texts that share a hash stay two groups. The grouping is a hash aggregate with map-side
combine: a text that a third of all rows share leaves each map task as one row. A row then
finds its group by (hash, SHA-256) in a join of narrow rows, whose hot keys adaptive
execution can split because one side holds one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, whole_text

_TWO_64 = "18446744073709551616"
_TWO_63 = "9223372036854775808"


def _preference(n: Column, doc_id: Column) -> Column:
    """One number that is smallest for the longest text, then the smallest id.

    A decimal is a fixed-width aggregation buffer, so the group-by on whole texts stays a
    hash aggregate; a struct would make Spark sort the texts.
    """
    ranked = (F.lit(2147483647) - n).cast("decimal(38,0)") * F.expr(f"cast({_TWO_64} as decimal(38,0))")
    return (ranked + doc_id.cast("decimal(38,0)") + F.expr(f"cast({_TWO_63} as decimal(38,0))")).cast("decimal(38,0)")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after the white space of ``SPACE_CLASS`` is
    deleted. Of equal texts the one with the most code points stays, then the smallest id.

    * null text: the empty text; all empty texts are one group.
    * null doc_id: such a row counts in its group; it stays only where no row has an id.
    * rows that repeat an id carry the same verdict each.
    * no rows: no rows. Other columns of the input, whatever their names, are not read.
    """
    norm = F.regexp_replace(whole_text(text), SPACE_CLASS + "+", "")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.length(whole_text(text)).alias("n"), norm.alias("norm"))
    rows = rows.select("doc_id", "n", "norm", F.unhex(F.md5("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256"))
    groups = (
        rows.groupBy("h", "text_sha256", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(_preference(F.col("n"), F.col("doc_id"))).alias("best"))
        .select("h", "text_sha256", "group_size", (F.col("best") % F.expr(f"cast({_TWO_64} as decimal(38,0))") - F.expr(f"cast({_TWO_63} as decimal(38,0))")).cast("bigint").alias("keep_id"))
    )
    return rows.select("doc_id", "h", "text_sha256").join(groups, ["h", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM rows
"""
