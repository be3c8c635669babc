"""Operator 3, approximate nearest neighbours by learned partitions.

On a bounded sample the neighbour graph is cut into equal parts (spectral bisection at the
median, level by level) and a small softmax classifier learns, from a vector, where the
neighbours of its like lie. The classifier then places every row in its most probable
partition and routes each query to its most probable ones, whose rows are ranked again by
exact distance. How many partitions a query visits is measured on sampled rows that the
classifier hasn't seen: the fewest that hold ``goal`` of their true neighbours. Data in
clusters cost a few visits; vectors without structure cost most of the partitions.

A partition of over ``LEAF`` rows is divided again in the same way, by a classifier fitted to a
sample of its own rows, and so on: partitions grow in number with the table, not in size. A
sample (about ``SAMPLE`` rows) is drawn from all rows of its partition and fitted in one task;
the models are a table that is joined by partition, and nothing but counts reaches the driver.
Rows and queries of a partition are dealt into blocks
of about ``BLOCK``, so a vector that a third of all rows share, which no classifier divides,
fills many blocks, each searched by its own task.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, written

SAMPLE = 4096
PARTITIONS = 32
#: A partition is learned from this many sampled rows at least; smaller tables have fewer partitions.
ROWS_PER_PARTITION = 128
LEAF = 32_768
BLOCK = 16_384
GOAL = 0.95
MOST_PATHS = 100_000
_NEAR = 10
_HUGE, _TINY = 2.0**500, 2.0**-500


def _nearest(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k rows of y nearest to each row of x."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    d = (y * y).sum(1)[None] - 2 * (x @ y.T)
    return np.argpartition(d, min(k, len(y) - 1), axis=1)[:, :k]


def partition_graph(near: np.ndarray, parts: int) -> np.ndarray:
    """Equal parts (a power of two) of the graph that joins each row with its near rows."""
    n = len(near)
    weights = np.zeros((n, n), dtype=np.float32)
    weights[np.arange(n)[:, None], near] = 1
    weights = np.maximum(weights, weights.T)
    part = np.zeros(n, dtype=np.int64)
    rng = np.random.default_rng(7)
    for _ in range(int(np.log2(parts))):
        new = part * 2
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            w = weights[np.ix_(at, at)]
            scale = 1 / np.sqrt(w.sum(1) + 1e-3)
            trivial = 1 / scale / np.linalg.norm(1 / scale)
            v = rng.standard_normal(len(at))
            for _ in range(60):  # power iteration for the second eigenvector of the normalised graph
                v = v - trivial * (trivial @ v)
                v = v + scale * (w @ (scale * v))
                v /= np.linalg.norm(v) + 1e-30
            new[at[np.argsort(v * scale, kind="stable")[len(at) // 2 :]]] += 1
        part = new
    return part


def fit_classifier(x: np.ndarray, target: np.ndarray, hidden: int = 64, epochs: int = 60) -> list[np.ndarray]:
    """A network of one hidden layer, trained with Adam on cross-entropy against target's shares."""
    rng = np.random.default_rng(11)
    p = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, target.shape[1])) / np.sqrt(hidden), np.zeros(target.shape[1])]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.tanh(x[at] @ p[0] + p[1])
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(1, keepdims=True))
            dz = (z / z.sum(1, keepdims=True) - target[at]) / len(at)
            dh = (dz @ p[2].T) * (1 - h * h)
            t += 1
            for i, g in enumerate((x[at].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                g = g + 1e-4 * p[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p


class Router:
    """Orders the parts of a partition, for a vector, from most to least probable."""

    def __init__(self, sample: np.ndarray, goal: float = GOAL) -> None:
        self.unit = np.abs(sample).max()
        self.mean, self.scale = 0.0, 1.0
        x = sample / self.unit
        self.mean, self.scale = x.mean(0), x.std() + 1e-12
        x = self._features(sample)
        self.parts = int(2 ** np.floor(np.log2(max(1, min(PARTITIONS, len(x) // ROWS_PER_PARTITION)))))
        near = _nearest(x, x, min(_NEAR + 1, len(x)))
        part = partition_graph(near, self.parts)
        share = np.zeros((len(x), self.parts))
        for j in range(near.shape[1]):
            share[np.arange(len(x)), part[near[:, j]]] += 1 / near.shape[1]
        held = np.arange(len(x)) % 4 == 0  # visits are measured on rows that the classifier hasn't seen
        fit = ~held if self.parts > 1 else held
        self.net = fit_classifier(x[fit], share[fit])
        order, home = self.order(sample[held]), self.order(sample)[:, 0]
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(self.parts)[None], axis=1)
        ranks = np.take_along_axis(rank, home[near[held]], axis=1)
        self.visits = int(np.quantile(ranks, goal, method="higher")) + 1 if held.any() else self.parts

    def _features(self, vectors: np.ndarray) -> np.ndarray:
        return np.clip((vectors / self.unit - self.mean) / self.scale, -1e3, 1e3)

    def order(self, vectors: np.ndarray) -> np.ndarray:
        h = np.tanh(self._features(vectors) @ self.net[0] + self.net[1])
        return np.argsort(-(h @ self.net[2] + self.net[3]), axis=1, kind="stable")

    def routes(self, vectors: np.ndarray, sizes: np.ndarray, k: int) -> list[list[int]]:
        """The parts each vector visits: the most probable ones, more only if these hold fewer than k other rows."""
        order = self.order(vectors)
        held = np.cumsum(sizes[order], axis=1)
        enough = np.where(held[:, -1] > k, np.argmax(held > k, axis=1) + 1, self.parts)
        return [o[: max(self.visits, n)].tolist() for o, n in zip(order, enough)]


def _matrix(column) -> np.ndarray:
    return np.array(column.to_list() if isinstance(column, pd.Series) else column.to_pylist(), dtype=np.float64)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; rows whose squares would overflow or vanish are scaled by a power of two."""
    d = x - q
    with np.errstate(over="ignore"):
        score = np.sqrt((d * d).sum(1))
    odd = np.flatnonzero(~((score < _HUGE) & (score > _TINY)))
    if len(odd):
        half = x[odd] / 2 - q / 2
        unit = np.exp2(np.floor(np.log2(np.maximum(np.abs(half).max(1), 5e-324))))
        with np.errstate(over="ignore"):
            score[odd] = np.sqrt(((half / unit[:, None]) ** 2).sum(1)) * unit * 2
    return score


def search_block(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each query, the k nearest of these rows: exact distances, ties to the smaller id, never itself."""
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(rows) or not len(queries):
        return empty
    x, ids, asked = _matrix(rows["v"]), rows["vec_id"].to_numpy(), _matrix(queries["v"])
    most = max(np.abs(x).max(), np.abs(asked).max())
    unit = 1.0 if _TINY < most < _HUGE else np.exp2(np.floor(np.log2(most)))
    small, found = x / unit, []
    squares = (small * small).sum(1)
    for at in np.array_split(np.arange(len(queries)), len(queries) // 256 + 1):
        q, q_ids = asked[at], queries["vec_id"].to_numpy()[at]
        small_q = q / unit
        rough = squares[None] - 2 * small_q @ small.T
        rough[q_ids[:, None] == ids[None]] = np.inf
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if k <= len(x) else np.full(len(q), np.inf)
        slack = 1e-9 * (squares.max() + (small_q * small_q).sum(1) + 1e-300)
        for i in range(len(q)):
            near = np.flatnonzero((rough[i] <= kth[i] + slack[i]) & (q_ids[i] != ids))
            score = distances(x[near], q[i])
            best = np.lexsort((ids[near], score))[:k]
            found.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[near][best], "score": score[best]}))
    return pd.concat(found) if found else empty


def _root() -> Column:
    """The path of what is in no partition yet: 0, but no literal, as the optimizer makes products of joins on a constant."""
    return (F.col("vec_id") * 0).alias("path")


def _with_path(entries: DataFrame, table: DataFrame) -> DataFrame:
    """entries joined with a written table of one row a partition.

    Up to ``MOST_PATHS`` rows it goes to all tasks, so that no partition's entries are gathered in
    one; beyond that there are partitions enough to deal entries by.
    """
    few = table.limit(MOST_PATHS + 1).count() <= MOST_PATHS
    return entries.join(F.broadcast(table) if few else table, "path")


def _dealt(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """entries with a block: one of as many as ``blocks`` (path, blocks) gives their partition."""
    return _with_path(entries, blocks).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")


def _blocks(entries: DataFrame) -> DataFrame:
    return entries.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))


def _descend(entries: DataFrame, models: DataFrame, choose) -> DataFrame:
    """path, vec_id, v one level down: in the parts that choose(model row, vectors) names; without a model, in the only part."""

    def run(mine: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({"path": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "v": pd.Series(dtype="object")})
        parts = choose(model.iloc[0], _matrix(mine["v"])) if len(model) else [[0]] * len(mine)
        times = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.repeat(np.arange(len(mine)), times)
        return pd.DataFrame({"path": mine["path"].to_numpy()[at] * PARTITIONS + np.concatenate(parts).astype(np.int64), "vec_id": mine["vec_id"].to_numpy()[at], "v": mine["v"].to_numpy()[at]})

    blocks = checkpointed(_blocks(entries))
    shared = models.join(blocks, "path").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return _dealt(entries, blocks).groupBy("path", "block").cogroup(shared.groupBy("path", "block")).applyInPandas(run, "path bigint, vec_id bigint, v array<double>")


def _fit(sample: int, goal: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        picked = rows.sort_values(["h", "vec_id"]).head(sample)
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "model": [pickle.dumps(Router(_matrix(picked["v"]), goal))]})

    return run


def build_index(rows: DataFrame, sample: int = SAMPLE, goal: float = GOAL, leaf: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(every row in its leaf: path, vec_id, v; the models of each level: path, model, sizes of the parts). rows: vec_id, v.

    The levels are as many as equal parts would need; what is still over ``leaf`` rows then holds
    vectors too alike to be divided. ``goal`` is met level by level, so that it holds for all together.
    """
    leaf, n = leaf or LEAF, rows.count()
    levels = max(1, int(np.ceil(np.log(max(n / leaf, 1)) / np.log(PARTITIONS))))
    placed, index = rows.select(_root(), "vec_id", "v"), []
    for level in range(levels):
        large = written(placed.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > (leaf if level else 0)))
        h = F.xxhash64("vec_id", F.lit(level))
        share = F.col("n") <= sample if level else F.lit(False)
        drawn = _with_path(placed, large).withColumn("h", h).filter(share | (F.pmod(h, F.lit(1 << 30)) <= F.lit(float(1 << 30)) * (1.1 * sample + 100) / F.col("n")))  # some more than the fit takes
        drawn = drawn.groupBy("path", "vec_id", "h").agg(F.any_value("v").alias("v"))  # an id that very many rows repeat is one row of the sample
        models = written(drawn.groupBy("path").applyInPandas(_fit(sample, goal ** (1 / levels)), "path bigint, model binary"))
        if level and models.isEmpty():
            break
        placed = written(_descend(placed, models, lambda m, v: pickle.loads(m["model"]).order(v)[:, :1].tolist()))
        part = F.struct(F.pmod("path", F.lit(PARTITIONS)).alias("part"), F.col("n"))
        sizes = placed.groupBy("path").agg(F.count(F.lit(1)).alias("n")).groupBy(F.floor(F.col("path") / PARTITIONS).alias("path")).agg(F.collect_list(part).alias("sizes"))
        index.append(written(models.join(sizes, "path")))
    return placed, index


def route_queries(asked: DataFrame, index: list[DataFrame], k: int) -> DataFrame:
    """path, vec_id, v: each query once a leaf that it visits. asked: vec_id, v."""

    def choose(model, matrix: np.ndarray) -> list[list[int]]:
        router, sizes = pickle.loads(model["model"]), np.zeros(PARTITIONS, dtype=np.int64)
        for s in model["sizes"]:
            sizes[s["part"]] = s["n"]
        return router.routes(matrix, sizes[: router.parts], k)

    routed = asked.select(_root(), "vec_id", "v")
    for models in index:
        routed = _descend(routed, models, choose)
    return routed


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, goal: float = GOAL, leaf: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in double precision).

    * vectors that are null, zero, or hold null or non-finite components take no part, as row
      or as query; neither do rows whose id is null.
    * vectors of several lengths: the length that most rows have (the smaller of two) is the
      table's, and vectors of another length take no part.
    * components whose squares overflow or vanish are scaled; a distance beyond double precision is infinite.
    * fewer than k other rows: all of them, wherever the classifier put them.
    * rows that repeat an id are candidates each, except for the query of that id.
    * no rows or no queries: no rows. Other columns of the inputs are not read.
    """
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    usable = lambda df: df.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0))
    rows, asked = usable(vectors), usable(queries)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows, asked = (df.filter(F.size("v") == length["n"]) for df in (rows, asked))
    placed, index = build_index(rows, sample, goal, leaf)
    routed = written(route_queries(asked, index, k))
    blocks, shares = written(_blocks(placed)), written(_blocks(routed).select("path", F.col("blocks").alias("shares")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = _with_path(_dealt(placed, blocks), shares).withColumn("share", each("shares")).drop("shares")
    theirs = _with_path(routed, shares).withColumn("share", F.pmod(F.xxhash64("vec_id"), F.col("shares")).cast("int")).drop("shares")
    theirs = _with_path(theirs, blocks).withColumn("block", each("blocks")).drop("blocks")
    key = ["path", "block", "share"]
    near = mine.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInPandas(lambda a, b: search_block(a, b, k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
