"""Average linkage of neighbours merged piece by piece.

A distance of merged clusters is a mean of distances that stood, so heights never fall, and what merges up
to a height h is connected by edges up to h. The connected pieces of those edges therefore merge
independently, each in a task of its own; that takes most merges off the graph. The distances between
clusters of two pieces depend on the order of the merges on both sides, so they are made up afterwards, for
each two pieces in a task, by going through the merges that touch edges between them in order. The smaller
graph is treated likewise with a greater h, until one task can finish.

The order of merges over all pieces is that in which one heap would give them out: by the greatest (height,
kept id, merged id) that the piece has had so far.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence
from math import inf

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .agglomeration import LABELS, in_one_task, in_sequence, numbered
from .graph import components

#: Clusters that one task finishes, and the most that a piece should have.
KERNEL, PIECE = 50_000, 20_000
#: The share of edges that a round starts with.
SHARE = 0.15

Step = tuple[float, int, int, int, int]


class Linkage:
    """Clusters with sizes, and the distances of those that are neighbours."""

    def __init__(self, n: dict[int, int], edges: Iterable[tuple[int, int, float]]):
        self.size, self.near = dict(n), {i: {} for i in n}
        for a, b, d in edges:
            self.near[a][b] = self.near[b][a] = d

    def join(self, a: int, b: int, n_a: int, n_b: int) -> dict[int, float]:
        """b becomes part of a; the new distances of a. Those to clusters next to both are means weighted by n_a and n_b."""
        near = self.near
        one, two = near.setdefault(a, {}), near.pop(b, {})
        one.pop(b, None)
        two.pop(a, None)
        for c, q in two.items():
            p = one.get(c)
            one[c] = q if p is None or p == q else (p * n_a + q * n_b) / (n_a + n_b)
            near[c].pop(b)
            near[c][a] = one[c]
        for c in one.keys() - two.keys():
            near[c][a] = one[c]
        return one

    def merged(self, until: float = inf) -> list[Step]:
        """(height, kept id, merged id, their sizes) of all merges up to a height; the least height first, then the least ids."""
        heap = [(d, a, b) for a, others in self.near.items() for b, d in others.items() if a < b]
        heapq.heapify(heap)
        out = []
        while heap and heap[0][0] <= until:
            d, a, b = heapq.heappop(heap)
            if a not in self.near or b not in self.near or self.near[a].get(b) != d:
                continue
            before = dict(self.near[a])
            out.append((d, a, b, self.size[a], self.size[b]))
            for c, e in self.join(a, b, self.size[a], self.size[b]).items():
                if before.get(c) != e:
                    heapq.heappush(heap, (e, min(a, c), max(a, c)))
            self.size[a] += self.size.pop(b)
        return out


def keyed(steps: list[Step]) -> list[tuple]:
    """The greatest (height, kept, merged) so far and the number of each step: sorted by these, the steps of many pieces are in the order of one heap."""
    out, top = [], (-inf, 0, 0)
    for k, step in enumerate(steps):
        top = max(top, step[:3])
        out.append((*top, k))
    return out


_FOUND = "kind int, piece long, other long, d double, a long, b long, n_a long, n_b long, key_d double, key_a long, key_b long, key_n long"
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
_MERGE, _EDGE, _CLUSTER, _REPLAY = range(4)
_ORDER = ["key_d", "key_a", "key_b", "key_n"]


def _piece(piece: int, nodes: list[tuple], edges: list[tuple], until: float) -> list[tuple]:
    state = Linkage({i: n for i, n, _ in nodes}, edges)
    outside = {i: {int(p) for p in others} for i, _, others in nodes if others is not None and len(others)}
    steps = state.merged(until)
    rows = []
    for step, order in zip(steps, keyed(steps), strict=True):
        rows.append((_MERGE, piece, None, *step, *order))
        gone = outside.pop(step[2], set())
        rows += [(_REPLAY, piece, other, *step, *order) for other in sorted(gone)]
        if gone:
            outside[step[1]] = outside.get(step[1], set()) | gone
    rows += [(_EDGE, piece, None, d, a, b, *[None] * 6) for a, others in state.near.items() for b, d in others.items() if a < b]
    rows += [(_CLUSTER, piece, None, None, i, None, n, *[None] * 5) for i, n in state.size.items()]
    return rows


def _by(frame: pd.DataFrame, keys: list[str], columns: list[str]) -> dict[tuple, list[tuple]]:
    """The rows of each key."""
    out: dict[tuple, list[tuple]] = {}
    for key, row in zip(frame[keys].itertuples(index=False, name=None), frame[columns].itertuples(index=False, name=None), strict=True):
        out.setdefault(key, []).append(row)
    return out


def _pieces(until: float):  # noqa: ANN202
    """The work of a task: many pieces, one after the other."""

    def work(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        within = _by(edges, ["piece"], ["src", "dst", "d"])
        rows = [row for key, own in _by(nodes, ["piece"], ["id", "n", "others"]).items() for row in _piece(key[0], own, within.get(key, []), until)]
        return pd.DataFrame(rows, columns=_NAMES, dtype=object)

    return work


def _between(edges: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
    """The edges between each two pieces after the steps of both. Many pairs of pieces at a time."""
    pair, rows = ["one", "two"], []
    taken = _by(steps.sort_values(_ORDER), pair, ["a", "b", "n_a", "n_b"])
    for key, own in _by(edges, pair, ["src", "dst", "d"]).items():
        if key not in taken:
            rows += own
            continue
        state = Linkage(dict.fromkeys({i for a, b, _ in own for i in (a, b)}, 0), own)
        for a, b, n_a, n_b in taken[key]:
            state.join(int(a), int(b), int(n_a), int(n_b))
        rows += [(a, b, d) for a, others in state.near.items() for b, d in others.items() if a < b]
    return pd.DataFrame(rows, columns=["src", "dst", "d"])


def _split(nodes: DataFrame, edges: DataFrame, piece: int) -> tuple[DataFrame, float]:
    """(cell_id, comp_id; the height): the pieces of the edges up to a height at which none has many more than `piece` clusters, if there is one."""
    share = SHARE
    while True:
        height = edges.approxQuantile("d", [share], 0.01)[0]
        comps = components(nodes.select(F.col("id").alias("cell_id"), F.lit(0).alias("cluster_id")), edges.where(F.col("d") <= height).select("src", "dst"))
        if share < 1e-3 or comps.groupBy("comp_id").count().agg(F.max("count")).first()[0] <= piece:
            return comps.select("cell_id", "comp_id"), height
        share /= 4


def _round(nodes: DataFrame, edges: DataFrame, piece: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters (id, n), edges (src, dst, d) and merges after the pieces have merged."""
    comps, height = _split(nodes, edges, piece)
    # pieces are many and small: a group takes all that share a bucket, since each group costs some milliseconds
    buckets = max(2 * nodes.sparkSession.sparkContext.defaultParallelism, nodes.count() // piece)
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).alias("bucket")
    end = lambda k, name: comps.select(F.col("cell_id").alias(k), F.col("comp_id").alias(name))
    placed = cut(edges.join(end("src", "p"), "src").join(end("dst", "q"), "dst"))
    across = placed.where("p <> q")
    outside = across.select(F.col("src").alias("id"), F.col("q").alias("other")).unionByName(across.select(F.col("dst").alias("id"), F.col("p").alias("other")))
    outside = outside.groupBy("id").agg(F.collect_set("other").alias("others"))
    rows = nodes.join(end("id", "piece"), "id").join(outside, "id", "left")
    within = placed.where("p = q").select(F.col("p").alias("piece"), "src", "dst", "d")
    found = cut(rows.withColumn("bucket", bucket("piece")).groupBy("bucket").cogroup(within.withColumn("bucket", bucket("piece")).groupBy("bucket")).applyInPandas(_pieces(height), _FOUND))
    pair = [F.least("p", "q").alias("one"), F.greatest("p", "q").alias("two")]
    steps = found.where(F.col("kind") == _REPLAY).withColumnsRenamed({"piece": "p", "other": "q"}).select(*pair, "d", "a", "b", "n_a", "n_b", *_ORDER)
    cross = across.select(*pair, "src", "dst", "d")
    cross = cross.withColumn("bucket", bucket("one", "two")).groupBy("bucket").cogroup(steps.withColumn("bucket", bucket("one", "two")).groupBy("bucket")).applyInPandas(_between, "src long, dst long, d double")
    inside = found.where(F.col("kind") == _EDGE).select(F.col("a").alias("src"), F.col("b").alias("dst"), "d")
    return found.where(F.col("kind") == _CLUSTER).select(F.col("a").alias("id"), F.col("n_a").alias("n")), cut(inside.unionByName(cross)), found.where(F.col("kind") == _MERGE).select("d", "a", "b", *_ORDER)


def merges(distances: DataFrame, cells: DataFrame, kernel: int = KERNEL, piece: int = PIECE) -> DataFrame:
    """d, a (kept), b (merged) and key_d, key_a, key_b, key_n, which give the order, of all merges of neighbours by average linkage.

    distances: src, dst, d, each edge once, not null; cells: cell_id. The same merges, distances and order as
    constrained_merges() makes in one task.
    """
    nodes, done = cells.select(F.col("cell_id").alias("id"), F.lit(1).cast("long").alias("n")), None
    edges = cut(distances.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "d"))
    while nodes.count() > kernel and edges.limit(1).count():
        nodes, edges, found = _round(nodes, edges, piece)
        done = found if done is None else done.unionByName(found)

    def finish(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        steps = Linkage(dict(zip(two["id"].tolist(), two["n"].tolist(), strict=True)), one[["src", "dst", "d"]].itertuples(index=False)).merged()
        return pd.DataFrame([(*s[:3], *k) for s, k in zip(steps, keyed(steps), strict=True)], columns=["d", "a", "b", *_ORDER])

    rest = in_one_task(edges.select("src", "dst", "d"), nodes, finish, "d double, a long, b long, key_d double, key_a long, key_b long, key_n long")
    return cut(rest if done is None else done.unionByName(rest))


def tree_labels(cells: DataFrame, found: DataFrame, ks: Sequence[int], kernel: int = KERNEL) -> DataFrame:
    """k, cell_id, cluster_id of merges as merges() gives them, for each k that they reach; clusters are numbered in order of their least cells.

    Up to `kernel` cells one task goes through the merges. Beyond, since a cluster is named after its least cell,
    merges point from a cell to the lesser one that its cluster joined, and cells follow these pointers, whose length
    doubles in every round. The driver sees the last merges only, as many as the greatest k.
    """
    n, m = cells.count(), found.count()
    if n <= kernel:

        def work(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
            steps = two.sort_values(_ORDER)[["d", "a", "b"]].itertuples(index=False, name=None)
            return numbered(in_sequence(one["cell_id"].tolist(), list(steps), ks))

        return in_one_task(cells.select("cell_id"), found, work, LABELS)
    wanted = [k for k in dict.fromkeys(ks) if n - m <= k <= n]
    last = [tuple(r) for r in found.orderBy(*[F.desc(c) for c in _ORDER]).limit(max(wanted, default=0)).select(*_ORDER).collect()]
    now = None
    for k in wanted:
        undone = k - (n - m)  # so many merges less
        some = found if undone == 0 else found.where(F.struct(*_ORDER) < F.struct(*[F.lit(v).cast("double" if c == "key_d" else "long").alias(c) for c, v in zip(_ORDER, last[undone - 1], strict=True)]))
        to = cells.select("cell_id").join(some.select(F.col("b").alias("cell_id"), F.col("a").alias("to")), "cell_id", "left").select(F.lit(k).cast("int").alias("k"), "cell_id", F.coalesce("to", "cell_id").alias("to"))
        now = to if now is None else now.unionByName(to)
    if now is None:
        return cells.sparkSession.createDataFrame([], LABELS)
    now, moved = cut(now), True
    while moved:
        further = cut(now.join(now.select("k", F.col("cell_id").alias("to"), F.col("to").alias("next")), ["k", "to"]).select("k", "cell_id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        now, moved = further.select("k", "cell_id", "to"), bool(further.where("moved").limit(1).count())
    number = now.select("k", "to").distinct().withColumn("cluster_id", (F.row_number().over(Window.partitionBy("k").orderBy("to")) - 1).cast("int"))  # k rows for each k
    return now.join(number, ["k", "to"]).select("k", "cell_id", "cluster_id")


def constrained(distances: DataFrame, cells: DataFrame, ks: Sequence[int], kernel: int = KERNEL, piece: int = PIECE) -> DataFrame:
    """k, cell_id, cluster_id of neighbour-constrained average linkage at each k. A graph in several pieces stops at one cluster a piece; smaller k are absent."""
    cells = cut(cells.select("cell_id"))
    return tree_labels(cells, merges(distances, cells, kernel, piece), ks, kernel)
