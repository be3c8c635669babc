"""Operator 6, token counts by trie-shared dynamic programming.

The distinct pre-tokens of a stretch of documents go into a trie. Unigram forward scores are
computed once for each trie node, so a prefix that many pre-tokens share is scored once; a
terminal node stores its pre-token's count of tokens on the best segmentation, and a
document's count is the sum over its pre-tokens. The work needs no shuffle at all: each task
reads its documents in stretches of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of
from .pieces import MODEL, Vocabulary, chunks, pre_tokens, read_model, totals, vocabulary


class WordTrie:
    """Nodes are distinct prefixes; node 0 is the empty one and parents precede children."""

    def __init__(self, words: list[bytes]) -> None:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        offsets = np.cumsum(lengths) - lengths
        self.terminal = np.zeros(len(words), dtype=np.int64)
        parents, values, levels = [np.zeros(1, np.int64)], [np.zeros(1, np.uint8)], [1]
        alive, depth, first = np.flatnonzero(lengths > 0), 0, 1
        while len(alive):
            keys, at = np.unique(self.terminal[alive] * 256 + data[offsets[alive] + depth], return_inverse=True)
            parents.append(keys >> 8)
            values.append((keys & 255).astype(np.uint8))
            self.terminal[alive] = at + first
            first += len(keys)
            levels.append(len(keys))
            depth += 1
            alive = alive[lengths[alive] > depth]
        self.parent, self.byte = np.concatenate(parents), np.concatenate(values)
        self.level_ends = np.cumsum(levels)
        n = len(self.parent)
        self.children = np.bincount(self.parent[1:], minlength=n)
        self.first_child = 1 + np.cumsum(self.children) - self.children  # siblings are consecutive

    def edges(self, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start node, end node, token id) of every piece in every prefix, and of byte fallbacks."""
        n = len(self.parent)
        pending = np.zeros(n, dtype=np.int8)  # bytes that the last character still lacks
        begin = np.zeros(n, dtype=np.int64)  # the node before the last character
        for a, b in zip(self.level_ends[:-1], self.level_ends[1:]):
            x, up = self.byte[a:b], self.parent[a:b]
            lead = np.select([x >= 0xF0, x >= 0xE0, x >= 0xC0], [3, 2, 1], 0).astype(np.int8)
            inside = pending[up] > 0
            pending[a:b] = np.where(inside, pending[up] - 1, lead)
            begin[a:b] = np.where(inside, begin[up], up)
        start = np.flatnonzero(pending == 0)
        at, node = start, np.zeros(len(start), dtype=np.int32)
        s, e, t = [], [], []
        covered = np.zeros(n, dtype=bool)
        while len(at):
            k = self.children[at]
            start, node = np.repeat(start, k), np.repeat(node, k)
            at = np.repeat(self.first_child[at] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            node = v.step(node, self.byte[at])
            on = node >= 0
            start, at, node = start[on], at[on], node[on]
            done = v.ends[node] >= 0
            s.append(start[done])
            e.append(at[done])
            t.append(v.ends[node[done]])
            covered[at[done & (begin[at] == start)]] = True
        bare = np.flatnonzero((pending == 0) & ~covered)
        bare = bare[bare > 0]
        while len(bare):  # the bytes of a character without a piece, last to first
            s.append(self.parent[bare])
            e.append(bare)
            t.append(v.byte_id[self.byte[bare]])
            bare = np.unique(self.parent[bare][self.parent[bare] != begin[bare]])
        s, e, t = np.concatenate(s), np.concatenate(e), np.concatenate(t)
        order = np.argsort(e, kind="stable")
        return s[order], e[order], t[order]


def forward(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: tokens of its best segmentation (ties to fewer), that one's log-probability, the sum over all."""
    trie = WordTrie(words)
    s, e, t = trie.edges(v)
    n = len(trie.parent)
    best, count, total = np.full(n, -np.inf), np.zeros(n, dtype=np.int64), np.full(n, -np.inf)
    best[0] = total[0] = 0.0
    cuts = np.searchsorted(e, trie.level_ends)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        ends, from_, p = e[a:b], s[a:b], v.logp[t[a:b]]
        first = np.flatnonzero(np.concatenate(([True], ends[1:] != ends[:-1])))
        width = np.diff(np.append(first, b - a))
        score = best[from_] + p
        top = np.maximum.reduceat(score, first)
        best[ends[first]] = top
        count[ends[first]] = np.minimum.reduceat(np.where(score == np.repeat(top, width), count[from_] + 1, np.iinfo(np.int64).max), first)
        weight = total[from_] + p
        high = np.maximum.reduceat(weight, first)
        total[ends[first]] = high + np.log(np.add.reduceat(np.exp(weight - np.repeat(high, width)), first))
    at = trie.terminal
    return count[at], best[at], total[at]


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model_path: str = MODEL) -> DataFrame:
    """One row per input row: doc_id, n_pre_tokens, n_tokens (bigint), best_log_prob, log_likelihood.

    n_tokens counts the most probable segmentation under the vocabulary's unigram model;
    log_likelihood sums over all segmentations.

    * null or empty text: zeros. Characters without a piece count one token a byte.
    * no rows: no rows; repeated rows give repeated rows. Other columns are not read.
    """
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            texts = bytes_of(batch.column(1))
            for part in chunks(texts):
                words, at, lengths = pre_tokens(texts[part])
                counts, best, total = forward(words, v) if words else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
                columns = [lengths, totals(counts[at], lengths), totals(best[at], lengths), totals(total[at], lengths)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], *map(pa.array, columns)], names=["doc_id", "n_pre_tokens", "n_tokens", "best_log_prob", "log_likelihood"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n_pre_tokens bigint, n_tokens bigint, best_log_prob double, log_likelihood double")
