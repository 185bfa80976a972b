"""Connected components as DataFrame rounds (alternating large-star and small-star)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Up to so many edges (4 MB) go to one task; more go in rounds.
TASK_EDGES = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the least node of its component within these edges."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    half = len(a)
    for x, y in zip(index[:half].tolist(), index[half:].tolist(), strict=True):
        x, y = find(x), find(y)
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.fromiter((find(x) for x in range(len(nodes))), np.int64, len(nodes))
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def local_forests(edges: DataFrame) -> DataFrame:
    """Each Arrow batch of edges (a, b) shrinks to a spanning forest with the same components."""

    def shrink(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            a, b = forest(x["a"].to_numpy(np.int64), x["b"].to_numpy(np.int64))
            yield pd.DataFrame({"a": a, "b": b})

    return edges.mapInPandas(shrink, "a long, b long")


def _in_one_task(edges: DataFrame) -> DataFrame:
    """As local_forests(), of all edges together."""

    def shrink(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [x.to_numpy(np.int64) for x in frames]
        a, b = forest(*np.concatenate(whole).T) if whole else np.empty((2, 0), np.int64)
        yield pd.DataFrame({"a": a, "b": b})

    return edges.select("a", "b").coalesce(1).mapInPandas(shrink, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60, most: int = TASK_EDGES) -> DataFrame:
    """(node, root) of every node that has an edge; root is the component's least node.

    edges: a, b (long), in any direction, repeats and loops allowed. Up to `most` edges end in one task, since
    a round is a dozen jobs, whose plans and threads the driver holds. Of more, every round hangs the larger
    neighbours of a node onto its least neighbour (large star), then the smaller ones (small star).
    The least neighbour comes from a partially aggregated groupBy and is cut before it is joined, so
    that both sides of the join are plain exchanges, whose skewed partitions Spark can split.
    """
    now = cut(local_forests(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct())

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(now)
    if not seen[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if seen[0] <= most:
        return cut(_in_one_task(now)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        star = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = cut(star.where("a <> b").distinct())
        least = cut(star.groupBy("a").agg(F.min("b").alias("m")))
        hung = star.join(least, "a")
        now = cut(hung.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        if (mark_now := mark(now)) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark_now
    raise RuntimeError("components did not settle; raise max_rounds")
