"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed, written

__all__ = ["SPACE_CLASS", "WORD_CLASS", "bytes_of", "checkpointed", "documents", "of_one_text", "packed", "portions", "released", "unpacked", "whole_text", "written"]

#: The characters that separate words in every contract: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def bytes_of(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8 bytes, null as empty, without decoding."""
    import pyarrow as pa

    values = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    return [v or b"" for v in values.to_pylist()]


def portions(batch, most: int = 1 << 22):
    """Slices of an Arrow batch that hold about ``most`` bytes on average, as a task needs Python objects of one slice only.

    What a slice's work has freed goes back to the system before the next.
    """
    n = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, n):
        yield batch.slice(start, n)
        released()


def released() -> None:
    """Gives freed memory back to the system: allocators keep it, and a worker serves one task after another."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that no name of theirs can clash with a column added beside it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def unpacked(columns: list[str], **new: str) -> list[Column]:
    """The ``packed`` columns of a struct ``row``; ``new`` names those that another column replaces."""
    return [F.col(new[c]).alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns]


def of_one_text(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id names one text, the others) of doc_id, text: null ids and ids that stand with different texts name none."""
    known, unknown = rows.filter("doc_id is not null"), rows.filter("doc_id is null")
    text = F.xxhash64(whole_text())
    several = checkpointed(known.groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).filter("a <> b").select("doc_id"))
    if several.isEmpty():
        return known, unknown
    return known.join(several, "doc_id", "left_anti"), unknown.union(known.join(several, "doc_id", "left_semi").select("doc_id", "text"))
