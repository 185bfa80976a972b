"""Exact top-k search by inner product: a ball tree per shard, branch and bound.

A top tree, fitted to a bounded sample, cuts the space into shards. Each shard's rows become one tree
of balls; a query can score at most <q, centre> + |q| * radius in a ball, so it visits nodes in the
order of that bound and stops when the bound falls below its k-th score so far. The shards are balls
too: queries go through them in waves, first the shard of the greatest bound, then the next few, then
all others, and after every wave the k-th scores are shared, so that a query skips the shards whose
bound is below its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, cut, reused, small_batches
from .vectors import by_dimension, usable

#: Balls of the top tree at most; larger inputs have larger shards, which are dealt over parts.
MOST_SHARDS = 4096


class BallTree:
    """Balls over integer rows. Leaves have at most `leaf` rows; `rows` puts the rows leaf by leaf."""

    def __init__(self, x: np.ndarray, leaf: int = 128):
        self.x = x.astype(np.float64)
        spans: list[tuple[int, int]] = []
        self.rows = np.arange(len(x))
        stack = [(0, len(x))]
        rng = np.random.default_rng(0)
        while stack:
            s, e = stack.pop()
            part = self.x[self.rows[s:e]]
            if e - s <= leaf or (part == part[0]).all():
                spans.append((s, e))
                continue
            # split at the median of the direction between two far rows, which exists however many rows are equal
            a = part[np.square(part - part[rng.integers(len(part))]).sum(axis=1).argmax()]
            b = part[np.square(part - a).sum(axis=1).argmax()]
            order = np.argsort(part @ (b - a), kind="stable")
            self.rows[s:e] = self.rows[s:e][order]
            middle = (s + e) // 2
            stack += [(middle, e), (s, middle)]
        self.spans = sorted(spans)
        self.x = self.x[self.rows]
        self.centres = np.stack([self.x[s:e].mean(axis=0) for s, e in self.spans])
        self.radii = np.array([np.sqrt(np.square(self.x[s:e] - c).sum(axis=1).max()) for (s, e), c in zip(self.spans, self.centres, strict=True)])
        # the levels above the leaves: pairs of neighbours, up to the root
        self.levels = [(self.centres, self.radii)]
        while len(self.levels[-1][0]) > 1:
            c, r = self.levels[-1]
            centres, radii = [], []
            for i in range(0, len(c), 2):
                m = c[i : i + 2].mean(axis=0)
                centres.append(m)
                radii.append(max(np.linalg.norm(y - m) + s for y, s in zip(c[i : i + 2], r[i : i + 2], strict=True)))
            self.levels.append((np.stack(centres), np.array(radii)))

    def bounds(self, q: np.ndarray, norms: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """For each query and leaf the upper bound of the score, -inf where a ball above it is already below the floor."""
        alive = np.ones((len(q), 1), bool)
        for depth in range(len(self.levels) - 1, -1, -1):
            c, r = self.levels[depth]
            if depth < len(self.levels) - 1:
                alive = np.repeat(alive, 2, axis=1)[:, : len(c)]
            top = q @ c.T + norms[:, None] * r[None, :]
            top += 1e-6 + 1e-9 * np.abs(top)  # for rounding
            alive = alive & (top >= floor[:, None])
        return np.where(alive, top, -np.inf)

    def search(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each query's best k rows here among those that reach its floor. own: the query's own id."""
        ids = ids[self.rows]
        q = q.astype(np.float64)
        norms = np.linalg.norm(q, axis=1)
        limit = floor.astype(np.float64)
        bounds = self.bounds(q, norms, limit)
        order = np.argsort(-bounds, axis=1, kind="stable")
        best_score = np.full((len(q), k), -np.inf)
        best_id = np.full((len(q), k), np.iinfo(np.int64).max)
        for step in range(bounds.shape[1]):
            leaf = order[:, step]
            alive = np.flatnonzero((bounds[np.arange(len(q)), leaf] >= limit) & np.isfinite(bounds[np.arange(len(q)), leaf]))
            if not len(alive):
                break
            for one in np.unique(leaf[alive]):
                who = alive[leaf[alive] == one]
                s, e = self.spans[one]
                scores = q[who] @ self.x[s:e].T
                scores[(ids[None, s:e] == own[who][:, None]) | (scores < limit[who][:, None])] = -np.inf
                every = np.concatenate([best_score[who], scores], axis=1)
                names = np.concatenate([best_id[who], np.broadcast_to(ids[s:e], scores.shape)], axis=1)
                names = np.where(np.isfinite(every), names, np.iinfo(np.int64).max)
                first = np.lexsort((names, -every), axis=1)[:, :k]
                best_score[who], best_id[who] = np.take_along_axis(every, first, 1), np.take_along_axis(names, first, 1)
                limit[who] = np.maximum(limit[who], best_score[who, -1])
        a, b = np.nonzero(np.isfinite(best_score))
        return a, best_id[a, b], best_score[a, b]


class TopTree:
    """Shards of the space of one dimension: halves at medians of a sample, again and again. At most MOST_SHARDS leaves."""

    def __init__(self, x: np.ndarray, shards: int, number: int):
        self.nodes: list[tuple[np.ndarray, float, int, int]] = []  # direction, threshold, children (negative: leaf)
        self.centres: list[np.ndarray] = []
        self.number = number  # of the first leaf
        rng = np.random.default_rng(0)
        self.root = self._grow(x, shards, rng)

    def _grow(self, x: np.ndarray, shards: int, rng: np.random.Generator) -> int:
        if shards < 2 or len(x) < 4 or (x == x[0]).all():
            self.centres.append(x.mean(axis=0))
            return -len(self.centres)
        a = x[np.square(x - x[rng.integers(len(x))]).sum(axis=1).argmax()]
        b = x[np.square(x - a).sum(axis=1).argmax()]
        along = x @ (b - a)
        threshold = float(np.median(along))
        left = along < threshold
        if not left.any():
            left = along <= threshold
        if left.all():
            self.centres.append(x.mean(axis=0))
            return -len(self.centres)
        at = len(self.nodes)
        self.nodes.append((b - a, threshold, 0, 0))
        low, high = self._grow(x[left], shards // 2, rng), self._grow(x[~left], shards - shards // 2, rng)
        self.nodes[at] = (b - a, threshold, low, high)
        return at

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard of each row and its distance from the shard's centre."""
        shard = np.zeros(len(x), np.int64)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                shard[rows] = -node - 1
                continue
            direction, threshold, low, high = self.nodes[node]
            left = x[rows] @ direction < threshold
            stack += [(low, rows[left]), (high, rows[~left])]
        return shard + self.number, np.linalg.norm(x - np.stack(self.centres)[shard], axis=1)


def _top_trees(rows: DataFrame, shard_rows: int, sample: int) -> dict[int, TopTree]:
    """By dimension; fitted to at most `sample` vectors, picked by a digest."""
    counts = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    some = rows.orderBy(F.xxhash64("vec_id", "v")).limit(sample).select("v").toPandas()["v"]
    out, number = {}, 0
    for d in sorted(counts):
        x = [v for v in some if len(v) == d]
        x = np.stack(x).astype(np.float64) if x else np.zeros((1, d))
        out[d] = TopTree(x, min(MOST_SHARDS, -(-counts[d] // shard_rows)), number)
        number += len(out[d].centres)
    return out


def _dealt(rows: DataFrame, trees: dict[int, TopTree]) -> DataFrame:
    """vec_id, v, shard, far (the distance from the shard's centre)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4096):
            shard, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for at, x in by_dimension(batch.column(1)):
                shard[at], far[at] = trees[x.shape[1]].route(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(far)], ["vec_id", "v", "shard", "far"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, shard int, far double")


def _routed(asked: DataFrame, trees: dict[int, TopTree], radii: dict[int, float], first: int, last: int | None) -> DataFrame:
    """vec_id, v, floor, shard: each query at the shards whose places in the order of its bounds are from first to last, if they can hold a row that reaches its floor. asked: vec_id, v, floor."""
    present = {d: np.array([s for s in range(len(t.centres)) if s + t.number in radii], np.int64) for d, t in trees.items()}
    radius = {d: np.array([radii[s + trees[d].number] for s in present[d].tolist()]) for d in trees}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 512):
            floor = np.asarray(batch.column(2))
            for at, q in by_dimension(batch.column(1)):
                if q.shape[1] not in trees:
                    continue
                tree, here = trees[q.shape[1]], present[q.shape[1]]
                bound = q @ np.stack(tree.centres)[here].T + np.linalg.norm(q, axis=1)[:, None] * radius[q.shape[1]][None, :]
                bound += 1e-6 + 1e-9 * np.abs(bound)  # for rounding
                place = np.empty(bound.shape, np.int64)
                np.put_along_axis(place, np.argsort(-bound, axis=1, kind="stable"), np.arange(len(here))[None, :], axis=1)
                a, b = np.nonzero((place >= first) & (place < (last or len(here))) & (bound >= floor[at][:, None]))
                take = pa.array(at[a])
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array((here[b] + tree.number).astype(np.int32))], ["vec_id", "v", "floor", "shard"])

    return asked.select("vec_id", "v", "floor").mapInArrow(run, "vec_id long, v array<long>, floor double, shard int")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def _search(routed: DataFrame, k: int, leaf: int) -> DataFrame:
    """The best rows of each query in each part of a shard. routed: shard, part, is_query, vec_id, v, floor; sorted by the first three, so a part's tree is built once, before its queries stream through."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tree, ids, most, held = None, None, None, 0.0, []
        for x in frames:
            key = x["shard"].to_numpy(np.int64) * 2**32 + x["part"].to_numpy()
            asks = x["is_query"].to_numpy(bool)
            edges = np.flatnonzero((key[1:] != key[:-1]) | (asks[1:] != asks[:-1])) + 1
            for s, e in zip([0, *edges], [*edges, len(x)], strict=True):
                if key[s] != now:
                    now, tree, held = key[s], None, []
                rows = x.iloc[s:e]
                if not asks[s]:
                    held.append(rows)
                    continue
                if tree is None:
                    if not held:
                        continue
                    whole = pd.concat(held, ignore_index=True)
                    c, ids, held = _matrix(whole["v"]), whole["vec_id"].to_numpy(np.int64), []
                    most, tree = float(np.abs(c.astype(np.float64)).max()), BallTree(c, leaf)
                q, own = _matrix(rows["v"]), rows["vec_id"].to_numpy(np.int64)
                if most * float(np.abs(q.astype(np.float64)).max()) * q.shape[1] >= 2.0**53:
                    raise OverflowError("components are too large for exact scores in double precision")
                a, other, score = tree.search(q, own, ids, k, rows["floor"].to_numpy(np.float64))
                yield pd.DataFrame({"query_id": own[a], "vec_id": other, "score": score.astype(np.int64)})

    return routed.mapInPandas(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 16384, leaf: int = 128, sample: int = 20_000, waves: Sequence[int] = (1, 5)) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best other rows by inner product, ties to the smaller id.

    vectors, queries: vec_id, v (array of integers). Rows without id or vector take no part. Every row
    of vectors is a candidate, also those that repeat an id, but those with the query's own id; queries
    that repeat an id are one query (the greatest of their vectors, by order of arrays). Vectors of
    different lengths don't meet. Fewer candidates give fewer results; no rows in, no rows out.
    Components too large for exact sums in double precision raise OverflowError.

    waves: how many of the shards, in the order of a query's bounds, are searched before its k-th score
    is shared again. A shard that holds more than shard_rows rows, equal ones for instance, is dealt
    over parts. Memory: a task holds one part of a shard and an Arrow batch of queries; the top tree
    has at most MOST_SHARDS balls, whatever the input.
    """
    spark = vectors.sparkSession
    plain = lambda x: columns_of(x, "vec_id", "v").where("vec_id is not null and v is not null")
    rows = plain(vectors)
    trees = _top_trees(rows, shard_rows, sample)
    dealt = reused(_dealt(rows, trees))
    balls = dealt.groupBy("shard").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()
    radii = {r["shard"]: r["far"] * (1 + 1e-9) + 1e-9 for r in balls}
    parts = F.broadcast(spark.createDataFrame([(r["shard"], -(-r["n"] // shard_rows)) for r in balls], "shard int, parts int"))
    candidates = dealt.join(parts, "shard").select("shard", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_query"), "vec_id", "v", F.lit(0.0).alias("floor"))
    asked = reused(plain(queries).groupBy("vec_id").agg(F.max("v").alias("v")))
    lowest = F.lit(float("-inf"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, stops = None, [*(w for w in waves if w < len(radii)), None]
    n_parts = max(1, min(sum(-(-r["n"] // shard_rows) for r in balls), 4 * spark.sparkContext.defaultParallelism))
    for first, last in zip([0, *stops], stops, strict=False):
        if best is None:
            known = asked.withColumn("floor", lowest)
        else:
            kth = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("kth"))
            known = asked.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("floor", F.coalesce("kth", lowest))
        routed = _routed(known, trees, radii, first, last).join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        both = candidates.unionByName(routed.select("shard", "part", F.lit(True).alias("is_query"), "vec_id", "v", "floor"))
        found = _search(both.repartition(n_parts, "shard", "part").sortWithinPartitions("shard", "part", "is_query"), k, leaf)
        found = found if best is None else best.unionByName(found)
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
        best = cut(best) if last is not None else best
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")


def integer_vectors(frame: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: each component x becomes floor(scale * x), x as double. Vectors null or holding null or non-finite components are left out."""
    rows = columns_of(frame, "vec_id", "embedding").where(usable(F.col("embedding")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
