"""A SentencePiece vocabulary as a byte trie, for the lattice operators.

The vocabulary's file is never trained or changed. It holds merge ranks, not probabilities,
so a piece of rank r gets the unigram probability 1 / (r + 1), normalised. Spaces are kept
as U+0020; U+2581 in a text is not a space and falls back to bytes, as any character
without a piece does, so encoding loses nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: No piece spans these boundaries: spaces stand only at a piece's start, U+000A only alone.
PRE_TOKEN = re.compile(rb"\n| *[^ \n]+| +")


#: Trie nodes of the first levels, up to so many in all, have a table of all next bytes (16 MB).
_DENSE = 1 << 14


def read_model(path: str = MODEL) -> bytes:
    """The file's bytes; read on the driver and sent with the tasks, as executors may not have the file."""
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.text = [b""] * n
        self.byte_id = np.full(256, -1, dtype=np.int32)
        ordinary = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.text[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[self.text[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text[i] = piece.replace("▁", " ").encode()
                ordinary.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte fallback")
        rank = np.full(n, float(len(ordinary)))  # bytes: below every piece
        by_score = sorted(ordinary, key=lambda i: (-sp.get_score(i), i))
        rank[by_score] = np.arange(len(by_score))
        self._bytes = pa.array(self.text, pa.large_binary())
        self.logp = -np.log(rank + 1) - np.log(np.sum(1 / (rank + 1)))
        nodes: list[dict[int, int]] = [{}]
        ends = [-1]
        for i in ordinary:
            at = 0
            for b in self.text[i]:
                if (to := nodes[at].get(b)) is None:
                    to = nodes[at][b] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                at = to
            ends[at] = i
        level, order, dense = [0], [], 0  # nodes are numbered level by level, so that those of a step lie together
        while level:
            order += level
            dense = len(order) if len(order) <= _DENSE else dense
            level = [to for at in level for to in nodes[at].values()]
        number = np.empty(len(nodes), dtype=np.int32)
        number[order] = np.arange(len(nodes))
        self.ends = np.array(ends, dtype=np.int32)[order]
        pairs = sorted((int(number[at]) * 256 + b, int(number[to])) for at, node in enumerate(nodes) for b, to in node.items())
        self._keys = np.array([k for k, _ in pairs] + [1 << 62], dtype=np.int64)
        self._to = np.array([t for _, t in pairs] + [-1], dtype=np.int32)
        self._dense = np.full((dense, 256), -1, dtype=np.int32)
        inner = self._keys < dense * 256
        self._dense.reshape(-1)[self._keys[inner]] = self._to[inner]

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie node after one more byte, -1 if no piece goes on like that."""
        if node.max(initial=0) < len(self._dense):
            return self._dense[node, byte]
        key = node.astype(np.int64) * 256 + byte
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._to[at], -1)

    def decode(self, ids) -> bytes:
        """The text of token ids: their bytes without the space that encoding puts in front."""
        return b"".join(map(self.text.__getitem__, ids))[1:]

    def decode_runs(self, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
        """As ``decode`` for each run of ids; ``ends`` has 0 and the end of each run."""
        taken = self._bytes.take(pa.array(ids))
        _, places, data = taken.buffers()
        data = memoryview(data or b"")
        at = np.frombuffer(places, np.int64)[ends].tolist() if len(ids) else [0] * len(ends)
        return [data[a + 1 : b] for a, b in zip(at[:-1], at[1:])]


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def pre_tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct pre-tokens, index of each occurrence's, occurrences per text), with the leading space put in."""
    index: defaultdict[bytes, int] = defaultdict()
    index.default_factory = index.__len__  # a new pre-token gets the next number
    found, lengths = [], np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            words = PRE_TOKEN.findall(b" " + t)
            lengths[i] = len(words)
            found += map(index.__getitem__, words)
    index.default_factory = None  # else the dict refers to itself, and stretch upon stretch stays until the collector comes by
    return list(index), np.array(found, dtype=np.int64), lengths


def chunks(texts: list[bytes], most: int = 1 << 20):
    """Slices of the list that hold about ``most`` bytes at most, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def totals(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths, each from its own values alone."""
    sums = np.zeros(len(lengths), dtype=values.dtype)
    some = lengths > 0
    if some.any():
        sums[some] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[some])
    return sums
