"""Average linkage and Ward's method over all pairs, from series instead of a table of pairs.

In every round all clusters that are each other's nearest merge, which gives the tree of one merge at a time.
Who is nearest is looked for once a cluster, and again only for clusters that have merged or whose nearest has:
no merge brings clusters nearer to a third than the nearer of both was. Those that look meet blocks of all clusters
in tasks, which make the distances a tile at a time and hand on the nearest of each cluster only, so a round's tables
have a row a cell, never one for two cells. Average linkage goes through the distances of cells anew; Ward's needs the
clusters' means only. Once few clusters are left, their matrix goes to one task in pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distances import metric
from ..lineage import cut, stored
from .agglomeration import KERNEL_CELLS, average_linkage, tree_labels
from .pairs import BLOCK, BLOCKS, LEAST, _cells
from .pairs import STRIP as TILE

#: From two tables of rows (id, n, latitude, longitude, x): the distances of rows of one to rows of the other, NaN where there is none.
Make = Callable[[pd.DataFrame, pd.DataFrame], Callable[[slice, slice], np.ndarray]]
_NEAREST, _PIECES = "id long, d double, other long", "a binary, b binary, n_a binary, n_b binary, d binary"
#: Groups of clusters that look for their nearest, at least, if they have LEAST cells each; rows of one side of a tile at least.
GROUPS, WIDTH = 3, 1 << 11


def _runs(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """First and last cluster (exclusive) of runs of whole clusters that have `size` rows, or a cluster only. ends: where each cluster's rows end."""
    k = 0
    while k < len(ends):
        last = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size, "right")))
        yield k, last
        k = last


def _added(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of x added up, n[0] of them, then n[1], ... By a product with ones and zeros, which is quicker than reduceat over short runs but spreads what isn't finite."""
    k = np.arange(len(n))
    found = (k[:, None] == np.repeat(k, n)[None, :]).astype(np.float64) @ x
    return found if np.isfinite(found.sum()) else np.add.reduceat(x, np.cumsum(n) - n, axis=0)


def _means(a: pd.DataFrame, b: pd.DataFrame, make: Make) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(places of the ids, ids of a, ids of b, mean distances) a tile at a time, each a tile of whole clusters. a, b: rows sorted by id."""
    ids_a, at_a, n_a = np.unique(a["id"].to_numpy(), return_index=True, return_counts=True)
    ids_b, at_b, n_b = np.unique(b["id"].to_numpy(), return_index=True, return_counts=True)
    distances, end_a, end_b = make(a, b), at_a + n_a, at_b + n_b
    for i, j in _runs(end_b, WIDTH):
        columns, alone = slice(at_b[i], end_b[j - 1]), j - i == end_b[j - 1] - at_b[i]
        height = max(1, TILE // (columns.stop - columns.start))
        for k, last in _runs(end_a, height):
            rows = end_a[last - 1] - at_a[k]
            if rows > height:  # one cluster, however large
                total = sum(distances(slice(at, min(at + height, end_a[k])), columns).sum(axis=0, keepdims=True) for at in range(at_a[k], end_a[k], height))
            else:
                total = distances(slice(at_a[k], end_a[last - 1]), columns)
                total = total if rows == last - k else _added(total, n_a[k:last])
            total = total if alone else np.add.reduceat(total, at_b[i:j] - at_b[i], axis=1)
            if rows > last - k or not alone:
                total /= n_a[k:last, None] * n_b[None, i:j]
            yield slice(k, last), ids_a[k:last], ids_b[i:j], total


def _met(sent: DataFrame, tasks: int, work: Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """work(a, b) of the rows of each task: those of one side (side 0) and those of the other (1), or one side twice where there is one only."""
    columns = ["id", "n", "latitude", "longitude", "x"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for frame in frames:
            for task, x in frame.groupby("task", sort=True):
                if task != now and held:
                    yield from both(pd.concat(held))
                    held = []
                now = task
                held.append(x)
        if held:
            yield from both(pd.concat(held))

    def both(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        a, b = (x.loc[x["side"] == k, columns].reset_index(drop=True) for k in (0, 1))
        if x["alone"].iloc[0]:
            yield from work(a, a)
        elif len(a) and len(b):
            yield from work(a, b)

    return sent.select("task", "side", "alone", "cell", *columns).repartitionById(tasks, "task").sortWithinPartitions("task", "side", "id", "cell").drop("cell").mapInPandas(run, schema)


def _dealt(name: str, n: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name)


def _blocks(rows: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]], schema: str, blocks: int) -> DataFrame:
    """work(a, b) of each two blocks of whole clusters, of a block with itself too (a is b), in one task each."""
    dealt = rows.select("*", _dealt("own", blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    sent = dealt.withColumns({"task": (high * (high + 1) / 2 + low).cast("int"), "side": (F.col("own") > F.col("other")).cast("int"), "alone": low == high})
    return _met(sent, blocks * (blocks + 1) // 2, work, schema)


def _searched(rows: DataFrame, make: Make, asking: int, blocks: int) -> DataFrame:
    """id, other, d: the nearest other cluster of each that asks. Those that ask, in groups, meet blocks of all."""
    groups = max(1, -(-asking // BLOCK), min(GROUPS, asking // LEAST))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ask = rows.where("ask").select("*", _dealt("g", groups)).withColumn("b", to(blocks)).withColumn("side", F.lit(0))
    every = rows.select("*", _dealt("b", blocks)).withColumn("g", to(groups)).withColumn("side", F.lit(1))
    sent = ask.unionByName(every).withColumns({"task": (F.col("g") * blocks + F.col("b")).cast("int"), "alone": F.lit(False)})

    def work(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        every = np.unique(a["id"].to_numpy())
        low, near = np.full(len(every), np.inf), np.zeros(len(every), np.int64)
        for k, ids, others, d in _means(a, b, make):
            own = np.flatnonzero(others[np.minimum(at := np.searchsorted(others, ids), len(others) - 1)] == ids)
            d[own, at[own]] = np.inf
            if np.isnan(d.min()):
                np.copyto(d, np.inf, where=np.isnan(d))
            at = d.argmin(axis=1)  # ids ascend, so of equals the least; later tiles have greater ones
            least = d[np.arange(len(ids)), at]
            better = least < low[k]
            low[k], near[k] = np.where(better, least, low[k]), np.where(better, others[at], near[k])
        there = np.isfinite(low)
        yield pd.DataFrame({"id": every[there], "d": low[there], "other": near[there]})

    found = _met(sent, groups * blocks, work, _NEAREST)
    return found.groupBy("id").agg(F.min(F.struct("d", "other")).alias("x")).select("id", "x.other", "x.d")


def _pieces(make: Make) -> Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]]:
    def work(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        n_a, n_b = (x.groupby("id")["n"].sum() for x in (a, b))
        for _, ids, others, d in _means(a, b, make):
            sizes = n_a.loc[ids].to_numpy(np.int64), n_b.loc[others].to_numpy(np.int64)
            yield pd.DataFrame({"a": [ids.tobytes()], "b": [others.tobytes()], "n_a": [sizes[0].tobytes()], "n_b": [sizes[1].tobytes()], "d": [d.tobytes()]})

    return work


def _rounds(rows: DataFrame, make: Make, joined: Callable[[DataFrame], DataFrame], ward: bool, kernel_cells: int) -> DataFrame:
    """d, keep, gone of all merges. rows: id, n (cells of the row), cell, latitude, longitude, x; joined(rows) are the rows after merges, from those before with the clusters that they go `to`."""
    rows, near, done = stored(rows.withColumn("ask", F.lit(True))), None, None
    clusters = rows.select("id").distinct().count()
    while True:
        n, asking = rows.agg(F.count(F.lit(1)), F.count_if("ask")).first()
        blocks = max(1, -(-n // BLOCK), min(BLOCKS, n // LEAST))
        if clusters <= kernel_cells:
            break
        found = _searched(rows, make, asking, blocks)
        near = stored(found if near is None else near.unionByName(found))
        merges = near.groupBy(F.least("id", "other").alias("keep"), F.greatest("id", "other").alias("gone")).agg(F.count(F.lit(1)).alias("k"), F.min("d").alias("d"))
        merges = stored(merges.where("k = 2").select("d", "keep", "gone"))
        made = merges.count()
        if not made:
            if asking == n:
                break  # no cluster has a partner
            rows, near = stored(rows.withColumn("ask", F.lit(True))), None  # what is known fits no pair, by rounding: all look again
            continue
        done, clusters = merges if done is None else done.unionByName(merges), clusters - made
        to = merges.select(F.explode(F.array("keep", "gone")).alias("id"), F.col("keep").alias("to"))
        near = stored(near.join(to, "id", "left").join(to.select(F.col("id").alias("other"), F.lit(True).alias("lost")), "other", "left").select("id", "other", "d", "to", "lost"))
        asks = near.where("to is not null or lost").select("id", F.coalesce("to", "id").alias("to"), F.col("to").isNotNull().alias("merged"))
        rows = stored(joined(rows.drop("ask").join(asks, "id", "left")).select("id", "n", "cell", "latitude", "longitude", "x", "ask"))
        near = near.where("to is null and lost is null").select("id", "other", "d")

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [[np.frombuffer(r[c], np.float64 if c == "d" else np.int64) for c in ("a", "b", "n_a", "n_b", "d")] for f in frames for _, r in f.iterrows()]
        if held:
            ids, first = np.unique(np.concatenate([x for r in held for x in r[:2]]), return_index=True)
            sizes = np.concatenate([x for r in held for x in r[2:4]])[first]
            d = np.full((len(ids), len(ids)), np.nan)
            for a, b, _, _, m in held:
                i, j = np.searchsorted(ids, a), np.searchsorted(ids, b)
                d[np.ix_(i, j)] = m.reshape(len(a), len(b))
                d[np.ix_(j, i)] = m.reshape(len(a), len(b)).T
            yield pd.DataFrame(average_linkage(ids, sizes, d, ward), columns=["d", "keep", "gone"])

    if clusters > kernel_cells:
        return done if done is not None else near.select("d", F.col("id").alias("keep"), F.col("other").alias("gone")).limit(0)
    rest = _blocks(rows, _pieces(make), _PIECES, blocks).repartition(1).mapInPandas(finish, "d double, keep long, gone long")
    return cut(rest if done is None else done.unionByName(rest))


def upgma_merges(series: DataFrame, name: str, kernel_cells: int = KERNEL_CELLS) -> DataFrame:
    """d, keep, gone: all merges of average linkage by a metric. Cells without a distance to any stay alone."""
    tiles = metric(name).tiles
    rows = series.select(F.col("cell_id").alias("id"), F.lit(1).cast("long").alias("n"), F.col("cell_id").alias("cell"), "latitude", "longitude", "x")

    def joined(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"id": F.coalesce("to", "id"), "ask": F.col("to").isNotNull()})

    return _rounds(rows, lambda a, b: tiles(_cells(a), _cells(b)), joined, False, kernel_cells)


def ward_merges(series: DataFrame, kernel_cells: int = KERNEL_CELLS) -> DataFrame:
    """d (growth of the sum of squares), keep, gone: all merges of Ward's method. Cells with equal series merge first, at 0."""
    square = metric("squared_euclidean").tiles
    least = cut(series.groupBy("x").agg(F.min("cell_id").alias("id"), F.count(F.lit(1)).alias("n")))
    copies = series.join(least.where("n > 1"), "x").where("cell_id <> id").select(F.lit(0.0).alias("d"), F.col("id").alias("keep"), F.col("cell_id").alias("gone"))
    rows = least.select("id", "n", F.col("id").alias("cell"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), "x")

    def growth(a: pd.DataFrame, b: pd.DataFrame) -> Callable[[slice, slice], np.ndarray]:
        n, m = (x["n"].to_numpy(np.float64) for x in (a, b))
        squares = square(_cells(a), _cells(b))

        def at(r: slice, c: slice) -> np.ndarray:
            d = squares(r, c)
            share = n[r, None] * m[None, c]
            share /= n[r, None] + m[None, c]
            d *= share
            return d

        return at

    def joined(rows: DataFrame) -> DataFrame:
        merged = F.coalesce("merged", F.lit(False))
        both = rows.where(merged).groupBy("to").agg(F.array_sort(F.collect_list(F.struct("id", "n", "x"))).alias("of"))
        both = both.select(F.col("to").alias("id"), F.col("of")[0].alias("p"), F.col("of")[1].alias("q")).withColumn("n", F.col("p.n") + F.col("q.n"))
        mean = F.zip_with("p.x", "q.x", lambda p, q: (p * F.col("p.n") + q * F.col("q.n")) / F.col("n"))
        fresh = both.select("id", "n", F.col("id").alias("cell"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), mean.alias("x"), F.lit(True).alias("ask"))
        return rows.where(~merged).withColumn("ask", F.col("to").isNotNull()).drop("to", "merged").unionByName(fresh)

    return _rounds(rows, growth, joined, True, kernel_cells).unionByName(copies)


def upgma(series: DataFrame, name: str, ks: Sequence[int], kernel_cells: int = KERNEL_CELLS) -> DataFrame:
    """k, cell_id, cluster_id of average linkage over all pairs of cells at each k."""
    return tree_labels(series, upgma_merges(series, name, kernel_cells), ks)


def ward(series: DataFrame, ks: Sequence[int], kernel_cells: int = KERNEL_CELLS) -> DataFrame:
    """k, cell_id, cluster_id of Ward's method over all pairs of cells at each k."""
    return tree_labels(series, ward_merges(series, kernel_cells), ks)
