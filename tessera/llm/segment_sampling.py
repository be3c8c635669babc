"""Operator 5, SentencePiece encoding and decoding: distinct sampled segmentations.

Gumbel top-k without replacement over the lattice of a whole text. Every lattice path gets
its log-probability plus a Gumbel noise; the k largest are k distinct samples. Only the
largest paths are ever built: the largest noisy value of a subtree has a known (truncated
Gumbel) law, so the search is A* with exact bounds. The first path is an ancestral sample.
Each node on a path bounds the best path that leaves it there; the node with the largest
bound is popped, leaves by an unused edge, and is followed to its end by another ancestral
sample. The (k+1)-th value is the threshold of the inclusion probabilities.

The lattice's backward sums are computed once for each distinct pre-token of a stretch of
documents. All noise comes from a counter hash of (row key, sample, place), so a row's
samples don't depend on its neighbours, the partitioning or a retry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import mix
from .common import bytes_of, portions
from .pieces import MODEL, Vocabulary, chunks, pre_tokens, read_model, vocabulary

SAMPLES = 2
SEED = 20_240_601
#: Bytes of text whose lattices and paths a task holds at once.
_STRETCH = 1 << 18


def uniform(key: np.ndarray, stream: int, place: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each (row key, stream, place)."""
    x = mix(key.astype(np.uint64) + np.uint64((stream * 0x9E3779B97F4A7C15) & (1 << 64) - 1))
    x = mix(x + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


class Lattice:
    """Lattices of distinct pre-tokens. State of byte i of word w: offset[w] + w + i; edges by state."""

    def __init__(self, words: list[bytes], v: Vocabulary) -> None:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        offsets = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(words)), lengths)
        self.start = offsets + np.arange(len(words))
        self.final = np.zeros(len(data) + len(words), dtype=bool)
        self.final[self.start + lengths] = True
        left = (offsets + lengths)[word] - np.arange(len(data))  # bytes from here to the word's end
        at = np.flatnonzero((data & 0xC0) != 0x80)
        reach = np.append(at[1:], len(data)) - at
        reach = np.minimum(reach, left[at])
        begin, node, width = at, np.zeros(len(at), dtype=np.int32), 0
        s, n, t = [], [], []
        covered = np.zeros(len(data), dtype=bool)
        size = np.zeros(len(data), dtype=np.int64)
        size[at] = reach
        while len(begin):
            node = v.step(node, data[begin + width])
            width += 1
            on = node >= 0
            begin, node = begin[on], node[on]
            done = v.ends[node] >= 0
            s.append(begin[done])
            n.append(np.full(done.sum(), width))
            t.append(v.ends[node[done]])
            covered[begin[done & (size[begin] == width)]] = True
            more = left[begin] > width
            begin, node = begin[more], node[more]
        bare = at[~covered[at]]
        bare = np.repeat(bare, size[bare]) + _ramp(size[bare])
        s, n, t = np.concatenate([bare, *s[::-1]]), np.concatenate([np.ones(len(bare), np.int64), *n[::-1]]), np.concatenate([v.byte_id[data[bare]], *t[::-1]])
        order = np.argsort(s, kind="stable")
        s, n, t = s[order], n[order], t[order]
        from_, to, score = s + word[s], s + word[s] + n, v.logp[t]
        back = np.where(self.final, 0.0, -np.inf)
        near = left[s]
        order = np.argsort(near.astype(np.uint16) if near.max(initial=0) < 1 << 16 else near, kind="stable")  # the states nearest to their word's end first
        near = near[order]
        cuts = np.append(np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1]))), len(s)) if len(s) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = order[a:b]
            x = from_[at]
            first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            width = np.diff(np.append(first, b - a))
            w = score[at] + back[to[at]]
            high = np.maximum.reduceat(w, first)
            back[x[first]] = high + np.log(np.add.reduceat(np.exp(w - np.repeat(high, width)), first))
        self.from_, self.to, self.token = from_, to, t  # a state's longest pieces first: mostly its likeliest, so that a draw looks at few
        self.logp = np.minimum(score + back[to] - back[from_], 0.0)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(from_, minlength=len(self.final)))))
        self._within = np.exp(self.logp)  # then the sum up to the edge within its state, added in the state's own order
        degree = np.diff(self.first)
        for r in range(1, int(degree.max(initial=0))):
            at = self.first[:-1][degree > r] + r
            self._within[at] += self._within[at - 1]
        self._within[self.first[self.from_ + 1] - 1] = np.inf  # the last edge takes what rounding leaves

    def sample(self, state: np.ndarray, key: np.ndarray, stream: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges of an ancestral sample from each state to its word's end, edges per state)."""
        steps, item = [], np.arange(len(state))
        count = np.zeros(len(state), dtype=np.int64)
        alive = ~self.final[state]
        item, state = item[alive], state[alive]
        while len(item):
            u = uniform(key[item], stream, place[item] + count[item])
            edge = self.first[state]
            on = np.flatnonzero(u >= self._within[edge])
            while len(on):
                edge[on] += 1
                on = on[u[on] >= self._within[edge[on]]]
            steps.append((item, count[item].copy(), edge))
            count[item] += 1
            state = self.to[edge]
            alive = ~self.final[state]
            item, state = item[alive], state[alive]
        offset = np.cumsum(count) - count
        edges = np.empty(count.sum(), dtype=np.int64)
        for item, step, edge in steps:
            edges[offset[item] + step] = edge
        return edges, count


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _below(bound: np.ndarray, mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel variable of location ``mass`` (a log-probability), truncated at ``bound``."""
    return -np.logaddexp(-bound, np.log(-np.log(u)) - mass)


class _Paths:
    """One path per text of ``doc``: its edges, the pre-token of each, and the bounds of leaving it there."""

    def __init__(self, lattice: Lattice, doc: np.ndarray, edges: np.ndarray, word: np.ndarray, count: np.ndarray, key: np.ndarray, value: np.ndarray, stream: int, since: np.ndarray) -> None:
        self.doc, self.edges, self.word, self.count, self.value = doc, edges, word, count, value
        self.offset = np.cumsum(count) - count
        self.of = np.repeat(np.arange(len(doc)), count)
        logp, place = lattice.logp[edges], _ramp(count)
        self.before, self.logp = np.zeros(len(edges)), np.zeros(len(doc))
        for i, (a, b) in enumerate(zip(self.offset.tolist(), (self.offset + count).tolist())):
            if b > a:  # summed text by text, so that a text's numbers don't depend on its neighbours
                upto = np.cumsum(logp[a:b])
                self.before[a + 1 : b] = upto[:-1]
                self.logp[i] = upto[-1]
        state = lattice.from_[edges]
        only = lattice.first[state + 1] - lattice.first[state] == 1
        with np.errstate(divide="ignore"):
            left = np.log(-np.expm1(logp))
        self.bound = _below(value[self.of], self.before + left, uniform(key[self.of], stream, place))
        self.bound[only | (place <= since[self.of])] = -np.inf  # up to the divergence the path's parent has the bounds

    def best(self, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text: the largest bound on its path, -inf if there is none, and the edge that has it."""
        top = np.full(len(self.doc), -np.inf)
        np.maximum.at(top, self.of, self.bound)
        at = np.flatnonzero((self.bound == top[self.of]) & np.isfinite(self.bound))
        row, i = np.unique(self.of[at], return_index=True)
        high, where = np.full(texts, -np.inf), np.full(texts, -1)
        high[self.doc[row]], where[self.doc[row]] = top[row], at[i]
        return high, where


def sample_segmentations(lattice: Lattice, word: np.ndarray, lengths: np.ndarray, seeds: np.ndarray, k: int) -> tuple[list[_Paths], np.ndarray]:
    """(the paths of rank 1, 2, .. k, the (k + 1)-th noisy value of each text; -inf where there is none).

    word: the pre-token of each occurrence, text by text; lengths: occurrences per text.
    """
    texts, stride = len(lengths), 1 << 24  # places of a pre-token's steps
    first = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(texts), lengths)
    edges, count = lattice.sample(lattice.start[word], seeds[owner], 1, _ramp(lengths) * stride)
    value = -np.log(-np.log(uniform(seeds, 0, np.zeros(texts))))
    tokens = np.bincount(owner, weights=count, minlength=texts).astype(np.int64)
    paths = [_Paths(lattice, np.arange(texts), edges, np.repeat(_ramp(lengths), count), tokens, seeds, value, 2, np.full(texts, -1))]
    used: dict[tuple[int, int], list[int]] = {}  # the edges already taken from a (path, place)
    while True:
        tops = [p.best(texts) for p in paths]
        high = np.stack([t[0] for t in tops])
        source, best = high.argmax(axis=0), high.max(axis=0)
        if len(paths) == k:
            return paths, best
        r, doc = len(paths), np.flatnonzero(np.isfinite(best))
        at = np.stack([t[1] for t in tops])[source[doc], doc]
        place, state, before = np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc))
        heads, turns = [slice(0)] * len(doc), np.zeros((len(doc), 3), dtype=np.int64)  # edge, place in the path, pre-token
        for j, p in enumerate(paths):
            mine = np.flatnonzero(source[doc] == j)
            starts = p.offset[p.of[at[mine]]]
            place[mine], state[mine], before[mine] = at[mine] - starts, lattice.from_[p.edges[at[mine]]], p.before[at[mine]]
            turns[mine, 2] = p.word[at[mine]]
            for i, a, b in zip(mine.tolist(), starts.tolist(), at[mine].tolist()):
                heads[i] = slice(a, b)
        turns[:, 1] = place
        u = uniform(np.repeat(seeds[doc], 2), 4 * r, (2 * place[:, None] + np.arange(2)).ravel()).reshape(-1, 2)
        rest = np.zeros(len(doc))  # what the turn leaves of the mass
        for i, (j, head, low, high) in enumerate(zip(source[doc].tolist(), heads, lattice.first[state].tolist(), lattice.first[state + 1].tolist())):
            taken = used.setdefault((j, head.stop), [int(paths[j].edges[head.stop])])
            free = np.array([e for e in range(low, high) if e not in taken])
            mass = np.exp(lattice.logp[free])
            total = mass.sum()
            k_th = min(int(mass.cumsum().searchsorted(u[i, 0] * total, side="right")), len(free) - 1)
            turns[i, 0] = free[k_th]
            taken.append(int(free[k_th]))
            rest[i] = total - mass[k_th] if len(free) > 1 else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(rest > 0, _below(best[doc], before + np.log(rest), u[:, 1]), -np.inf)
        for j, p in enumerate(paths):
            mine = source[doc] == j
            p.bound[at[mine]] = left[mine]
        n = lengths[doc] - turns[:, 2]  # the pre-token of the turn, from there on, and all after it
        owner, lead = np.repeat(np.arange(len(doc)), n), np.cumsum(n) - n
        which = _ramp(n) + turns[owner, 2]
        state = lattice.start[word[first[doc][owner] + which]]
        state[lead] = lattice.to[turns[:, 0]]
        tail, count = lattice.sample(state, seeds[doc][owner], 4 * r + 1, which * stride)
        tail_word, ends = np.repeat(which, count), np.cumsum(np.bincount(owner, weights=count, minlength=len(doc))).astype(np.int64)
        edges, words, tokens, start = [], [], np.zeros(len(doc), dtype=np.int64), 0
        for i, (d, head) in enumerate(zip(doc, heads)):
            p = paths[source[d]]
            edges += [p.edges[head], turns[i, :1], tail[start : ends[i]]]
            words += [p.word[head], turns[i, 2:], tail_word[start : ends[i]]]
            tokens[i] = head.stop - head.start + 1 + ends[i] - start
            start = ends[i]
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        paths.append(_Paths(lattice, doc, join(edges), join(words), tokens, seeds[doc], best[doc], 4 * r + 2, turns[:, 1]))


def encode_samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES, seed: int = SEED, model_path: str = MODEL, decoded: bool = False) -> DataFrame:
    """Up to ``samples`` rows per input row: doc_id, sample (from 1), ids, log_prob, perturbed, log_inclusion.

    decoded adds decoded_sha256: the digest of the text that the row's ids decode to.

    log_prob is the segmentation's log-probability given the text, perturbed its noisy value
    (descending in sample), log_inclusion the log-probability that it is among the samples
    given the (samples + 1)-th noisy value; 0 where the text has no more segmentations.

    * null or empty text: one sample without ids, of probability 1.
    * a text with fewer segmentations than samples gives all of them.
    * null doc_id is a row key of its own; rows that repeat an id repeat its noise.
    * no rows: no rows. Other columns of the input are not read.
    """
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in (x for whole in batches for x in portions(whole)):
            texts, ids = bytes_of(batch.column(1)), batch.column(0)
            for part in chunks(texts, _STRETCH):
                words, at, lengths = pre_tokens(texts[part])
                keys = ids[part.start : part.stop]
                seeds = mix(keys.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(seed))
                lattice = Lattice(words, v) if words else None
                if lattice is None:
                    n = len(lengths)
                    yield _rows(keys, np.ones(n, np.int32), np.zeros(n, np.int64), np.zeros(0, np.int32), np.zeros(n), -np.log(-np.log(uniform(seeds, 0, np.zeros(n, np.uint64)))), np.zeros(n), v if decoded else None)
                    continue
                paths, threshold = sample_segmentations(lattice, at, lengths, seeds, samples)
                for rank, p in enumerate(paths, 1):
                    gap = p.logp - threshold[p.doc]
                    with np.errstate(over="ignore", divide="ignore"):
                        inclusion = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700)))))
                    yield _rows(keys.take(pa.array(p.doc)), np.full(len(p.doc), rank, np.int32), p.count, lattice.token[p.edges].astype(np.int32), p.logp, p.value, inclusion, v if decoded else None)

    schema = "doc_id bigint, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double" + ", decoded_sha256 string" * decoded
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _rows(doc_id: pa.Array, rank: np.ndarray, count: np.ndarray, ids: np.ndarray, log_prob: np.ndarray, value: np.ndarray, inclusion: np.ndarray, decoder: Vocabulary | None) -> pa.RecordBatch:
    ends = np.concatenate(([0], np.cumsum(count)))
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
    columns = {"doc_id": doc_id, "sample": pa.array(rank), "ids": lists, "log_prob": pa.array(log_prob), "perturbed": pa.array(value), "log_inclusion": pa.array(inclusion)}
    if decoder is not None:
        columns["decoded_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in decoder.decode_runs(ids, ends)], pa.string())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def decode(rows: DataFrame, ids: str = "ids", into: str = "text", model_path: str = MODEL) -> DataFrame:
    """rows with ``into`` added: the text of the token ids; null ids give null, none the empty text."""
    model = read_model(model_path)
    schema = rows.drop(into).schema.add(into, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            texts = [None if x is None else v.decode(x).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return rows.drop(into).mapInArrow(run, schema)
