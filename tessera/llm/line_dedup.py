"""Operator 7, line deduplication by pairwise alignment.

A line shared by two or more distinct documents points every later holder to the first,
however many hold it. A document and one such first holder are a pair. Patience diff aligns
each pair on all lines that both hold, also those that a still earlier document held first,
and the aligned blocks go from the later document. Pairs number at most one per shared line
of a document: groups are stars, never all pairs.

Lines that a pair holds besides those of its first holder are found from the side that has
fewer shared lines, so a log of a million lines that meets many small documents is not read
again for each. Alignment and deletion are linear in a text's lines but for the sort of its
anchors.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, packed, portions, unpacked, written


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, content (digest of the text) to doc_id, content, line (digest), at (its places). Blank lines have no digest."""
    digest = xxhash.xxh3_128_digest
    for batch in (x for whole in batches for x in portions(whole)):
        ids, contents, lines, places = [], [], [], []
        for doc_id, text, content in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), batch.column(2).to_pylist()):
            at: dict[bytes, list[int]] = {}
            for i, line in enumerate(text.split(b"\n")):
                if line and not line.isspace():
                    at.setdefault(digest(line), []).append(i)
            ids += [doc_id] * len(at)
            contents += [content] * len(at)
            lines += at
            places += at.values()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(contents, pa.string()), pa.array(lines, pa.binary()), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "content", "line", "at"])


def patience(shared: list[tuple[list[int], list[int]]]) -> list[int]:
    """Lines of the later document in blocks aligned with the first: places of each shared line in both.

    Lines that occur once in each are anchors; the longest run of anchors in both orders
    stays. Each anchor's block then grows, before and after, over neighbours that are equal.
    """
    other = {i: places for xs, ys in shared for places in [frozenset(ys)] for i in xs}
    anchors = sorted((xs[0], ys[0]) for xs, ys in shared if len(xs) == len(ys) == 1)
    tails, tail_at, back = [], [], [-1] * len(anchors)
    for k, (_, y) in enumerate(anchors):
        p = bisect_left(tails, y)
        back[k] = tail_at[p - 1] if p else -1
        tails[p : p + 1], tail_at[p : p + 1] = [y], [k]
    kept, k = [], tail_at[-1] if tail_at else -1
    while k >= 0:
        kept.append(anchors[k])
        k = back[k]
    kept.reverse()
    if not kept and shared:  # nothing occurs once in both: the first equal lines align
        kept = [min((xs[0], ys[0]) for xs, ys in shared)]
    gone: dict[int, int] = dict(kept)
    used = set(gone.values())
    for step, start in ((1, kept), (-1, kept[::-1])):
        for x, y in start:
            while (x := x + step) not in gone and (y := y + step) not in used and y in other.get(x, ()):
                gone[x] = y
                used.add(y)
    return sorted(gone)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, shared to doc, gone; a pair's lines are unpacked one pair at a time."""
    for batch in batches:
        gone = [patience([(s["x"], s["y"]) for s in shared.as_py()]) for shared in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["doc", "gone"])


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, text, gone (lists of places), copy to row, text, n_lines, n_removed."""
    for batch in (x for whole in batches for x in portions(whole)):
        kept, n, removed = [], [], []
        for text, gone, copy in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist()):
            text = text.as_py()
            lines = [] if text is None else text.split("\n")
            left = lines
            if copy:
                left = [x for x in lines if _blank(x)]
            elif gone.is_valid:
                places = set(gone.values.flatten().to_pylist())
                left = [x for i, x in enumerate(lines) if i not in places]
            kept.append(text if left is lines else "\n".join(left))
            n.append(len(lines))
            removed.append(len(lines) - len(left))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=["row", "text", "n_lines", "n_removed"])


def _blank(line: str) -> bool:
    return not line.strip(" \t\n\x0b\x0c\r")


def aligned_lines(keyed: DataFrame) -> DataFrame:
    """doc (doc_id, content), gone (lists of places): the lines that alignment deletes. keyed: doc_id, text, content (a digest of text)."""
    lines = keyed.mapInArrow(_lines, "doc_id bigint, content string, line binary, at array<int>")
    lines = written(lines.groupBy("content", "line").agg(F.min("doc_id").alias("doc_id"), F.any_value("at").alias("at")))
    # written too, so that the join deals both sides anew and adaptive execution can split a line that very many hold
    holders = written(lines.groupBy("line").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("doc_id", "content", "at")).alias("first")).filter("df > 1").drop("df"))
    key = lambda d: F.struct(f"{d}doc_id", f"{d}content")
    shared = lines.join(holders, "line").filter(F.col("doc_id") != F.col("first.doc_id"))
    shared = written(shared.select(key("").alias("doc"), "line", F.col("at").alias("x"), key("first.").alias("first"), F.col("first.at").alias("y")))
    own = shared.select("doc", F.col("first").alias("to"), "x", "y")
    # a pair's first can hold those of the document's other lines that an earlier one held first
    size = written(shared.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.min("first.doc_id").alias("least")))
    pairs = shared.select("doc", F.col("first").alias("to")).distinct().join(size, "doc").filter(F.col("to.doc_id") > F.col("least"))
    pairs = written(pairs.join(size.select(F.col("doc").alias("to"), F.col("n").alias("to_n")), "to").select("doc", "to", (F.col("n") <= F.col("to_n")).alias("shorter")))
    mine, theirs = shared.select("doc", "line", "x"), shared.select(F.col("doc").alias("to"), "line", F.col("x").alias("y"))
    more = pairs.filter("shorter").join(mine, "doc").join(theirs, ["to", "line"]).select("doc", "to", "x", "y")
    more = more.union(pairs.filter("not shorter").join(theirs, "to").join(mine, ["doc", "line"]).select("doc", "to", "x", "y"))
    met = own.union(more).groupBy("doc", "to").agg(F.collect_list(F.struct("x", "y")).alias("shared"))
    gone = met.select("doc", "shared").mapInArrow(_align, "doc struct<doc_id: bigint, content: string>, gone array<int>")
    return gone.groupBy("doc").agg(F.collect_list("gone").alias("gone"))


def dedup_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row (a struct of all other columns), text (with the aligned lines deleted), n_lines, n_removed: as ``dedup_lines``, whatever the columns' names."""
    rows = docs.select(packed(docs.drop(text)).alias("row"), F.col(text).alias("text"), F.struct(F.col(doc_id).cast("bigint").alias("doc_id"), F.md5(text).alias("content")).alias("doc"))
    keyed = rows.select("doc.doc_id", "text", "doc.content").dropna()
    same = keyed.select("doc_id", "content")
    # written, so that the join deals rows anew and adaptive execution can split a text that very many share
    firsts = written(same.groupBy("content").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    copies = same.join(firsts, "content").filter("doc_id <> first").select(F.struct("doc_id", "content").alias("doc"), F.lit(True).alias("copy")).distinct()
    plan = aligned_lines(keyed).join(copies, "doc", "full")
    schema = rows.select("row", "text").schema.add("n_lines", "long").add("n_removed", "long")
    return rows.join(plan, "doc", "left").select("row", "text", "gone", "copy").mapInArrow(_delete, schema)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows with text's aligned lines deleted, and n_lines, n_removed (bigint) added.

    Lines end at U+000A and are equal when all their bytes are. Of documents with the same
    text the smallest id is the first; the others lose every line that is not blank.

    * null text stays null, with no lines. A text without line ends is one line.
    * blank lines are never compared or deleted.
    * null doc_id: such rows are neither compared nor changed; rows that repeat an id are not compared with each other.
    * columns named n_lines and n_removed in the input are replaced, all others come back as they are; no rows: no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return dedup_rows(docs, doc_id, text).select(*unpacked(names, **{text: "text"}), "n_lines", "n_removed")
