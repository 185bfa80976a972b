"""An affine subspace per cluster, costs, and assigning cells to the nearest.

Per cluster the state (n, sum of x, sum of x x^T) adds up over any parts of the cells, so it is made
per Arrow batch, summed in two steps, and gives mean, basis, explained share and cost at once: the
cost after a fresh fit is the trace of the scatter less its top eigenvalues. While a part has fewer
cells than times, their series stand for the sum of x x^T, being less. The fitted subspaces are
k matrices of m by T numbers, whatever the number of cells; those go to the executors with the kernel.

A round of a loop is one pass over series that stay where they are: a task assigns its cells by the old
subspaces and adds up the new states at once (assigned_states), on boundaries likewise with the labels of
neighbouring cells, which are all that moves between blocks of cells (boundary_round).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import xor

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..schema import SUBSPACES

#: Partial states are first merged in so many parts a cluster.
FAN = 16
#: d: squared distances to the subspaces that assigned the cells; mark: see marks().
_STATE = "cluster_id int, part int, n long, s binary, g binary, d double, mark long"
_FITTED = f"{SUBSPACES}, d double, mark long"


class State:
    """n, the sum of series, and the sum of their outer products or, as long as they are fewer than times, the series."""

    def __init__(self, n: int, s: np.ndarray, held: np.ndarray, d: float = 0.0, mark: int = 0):
        self.n, self.s, self.d, self.mark = n, s, d, mark
        self.held = held

    @classmethod
    def of(cls, x: np.ndarray, d: float = 0.0, mark: int = 0) -> State:
        return cls(len(x), x.sum(0), x if len(x) < x.shape[1] else x.T @ x, d, mark)

    @property
    def gram(self) -> np.ndarray:
        return self.held.T @ self.held if self.n < len(self.s) else self.held

    def add(self, other: State) -> None:
        few = self.n + other.n < len(self.s)
        self.held = np.concatenate([self.held, other.held]) if few else self.gram + other.gram
        self.n, self.s = self.n + other.n, self.s + other.s
        self.d, self.mark = self.d + other.d, self.mark ^ other.mark

    def row(self, cluster: int, part: int) -> tuple:
        return int(cluster), part, self.n, self.s.tobytes(), np.ascontiguousarray(self.held).tobytes(), self.d, self.mark


_COLUMNS = ["cluster_id", "part", "n", "s", "g", "d", "mark"]


def _total(x: pd.DataFrame) -> State:
    total = None
    for n, s, g, d, mark in x[["n", "s", "g", "d", "mark"]].itertuples(index=False):
        s = np.frombuffer(s)
        state = State(int(n), s, np.frombuffer(g).reshape(-1, len(s)), float(d), int(mark))
        if total is None:
            total = state
        else:
            total.add(state)
    return total


def _merged(x: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    total = _total(x)
    return total.n, total.s, total.gram


def no_rows(*columns: str) -> pd.DataFrame:
    """An empty frame whose columns take any type, lists too."""
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def marks(cells: np.ndarray, labels: np.ndarray) -> int:
    """A digest of which cell has which label: the exclusive or over all, so that parts add up in any order."""
    x = cells.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + labels.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return int(np.bitwise_xor.reduce(x ^ (x >> np.uint64(31))).astype(np.int64)) if len(x) else 0


def _merge_parts(parts: DataFrame, twice: bool = True) -> DataFrame:
    """States of the same cluster put together, in two steps if there are many parts; in order of parts, so that equal labels give equal states."""

    def merge(x: pd.DataFrame) -> pd.DataFrame:
        cluster = x["cluster_id"].iloc[0]
        return pd.DataFrame([_total(x.sort_values("part")).row(cluster, int(x["part"].min()))], columns=_COLUMNS)

    if twice:
        parts = parts.groupBy("cluster_id", (F.col("part") % FAN).alias("fan")).applyInPandas(lambda _, x: merge(x), _STATE)
    return parts


def _partial(labelled: DataFrame, columns: list[str], label: Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, State] = {}
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f["x"].to_numpy()).astype(np.float64)
            labels, d, cells = label(f, x)
            for c in np.unique(labels).tolist():
                own = labels == c
                state = State.of(x[own], float(d[own].sum()), marks(cells[own], labels[own]))
                if c in held:
                    held[c].add(state)
                else:
                    held[c] = state
        if held:
            part = TaskContext.get().partitionId() if TaskContext.get() else 0
            yield pd.DataFrame([state.row(c, part) for c, state in held.items()], columns=_COLUMNS)

    return labelled.select(*columns).mapInPandas(partial, _STATE)


def states(labelled: DataFrame) -> DataFrame:
    """cluster_id, n, s, g of rows (cluster_id, x, and cell_id if marks are asked for); x without nulls."""
    named = "cell_id" in labelled.columns

    def label(f: pd.DataFrame, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        labels = f["cluster_id"].to_numpy().astype(np.int64)
        return labels, np.zeros(len(f)), f["cell_id"].to_numpy() if named else labels

    rows = labelled.where("cluster_id is not null and x is not null")
    return _merge_parts(_partial(rows, ["cluster_id", "x", *(["cell_id"] if named else [])], label))


def assigned_states(series: DataFrame, subspaces: Subspaces) -> DataFrame:
    """The states of the clusters that series (cell_id, x) are nearest to; d is their squared distances. Labels are neither kept nor moved."""

    def label(f: pd.DataFrame, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = subspaces.distances(x)
        best = d.argmin(axis=1)
        return subspaces.ids[best], d[np.arange(len(d)), best], f["cell_id"].to_numpy()

    return _merge_parts(_partial(series, ["cell_id", "x"], label))


def spectrum(n: int, s: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, eigenvalues of the scatter (descending, not negative) and eigenvectors (rows)."""
    mean = s / n
    values, vectors = np.linalg.eigh(g - n * np.outer(mean, mean))
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order].T
    # the sign is free: the entry of largest size is positive
    vectors = vectors * np.where(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)] < 0, -1, 1)[:, None]
    return mean, np.maximum(values[order], 0), vectors


def fit(labelled: DataFrame, m: int) -> DataFrame:
    """subspaces of the clusters with more than m cells: n, mean, basis (m rows), explained, total_ss, residual_ss.

    A cluster of m cells or fewer has no row; series that aren't finite raise.
    """

    return fit_states(states(labelled), m).where("mean is not null").drop("d", "mark")


def fit_states(found: DataFrame, m: int) -> DataFrame:
    """subspaces of states, with d and mark of each; a cluster of m cells or fewer has neither mean nor basis."""

    def one(x: pd.DataFrame) -> pd.DataFrame:
        state = _total(x.sort_values("part"))
        n, s, g = state.n, state.s, state.gram
        row = {"cluster_id": [x["cluster_id"].iloc[0]], "n": [n], "mean": [None], "basis": [None], "explained": [None], "total_ss": [None], "residual_ss": [None], "d": [state.d], "mark": [state.mark]}
        if n > m:
            if not np.isfinite(g).all():
                raise RuntimeError("series with values that aren't finite can't be fitted")
            mean, values, vectors = spectrum(n, s, g)
            total, kept = float(values.sum()), float(values[:m].sum())
            row |= {"mean": [mean.tolist()], "basis": [vectors[:m].tolist()], "explained": [kept / total if total > 0 else 1.0], "total_ss": [total], "residual_ss": [max(0.0, total - kept)]}
        return pd.DataFrame(row)

    return found.groupBy("cluster_id").applyInPandas(one, _FITTED)


def costs(labelled: DataFrame, dimensions: list[int]) -> DataFrame:
    """m, cost, n_unfitted: the cost after a fresh fit for several m from one pass; clusters with m cells or fewer cost nothing and are counted."""

    def each(x: pd.DataFrame) -> pd.DataFrame:
        n, s, g = _merged(x)
        _, values, _ = spectrum(n, s, g)
        return pd.DataFrame([(m, float(values[m:].sum()) if n > m else 0.0, int(n <= m)) for m in dimensions], columns=["m", "cost", "unfitted"])

    found = states(labelled).groupBy("cluster_id").applyInPandas(each, "m int, cost double, unfitted int")
    return found.groupBy("m").agg(F.sum("cost").alias("cost"), F.sum("unfitted").alias("n_unfitted"))


def explained_by(series: DataFrame, counts: list[int]) -> DataFrame:
    """components, explained: the share of the whole field's variance in its first so many components."""

    def each(x: pd.DataFrame) -> pd.DataFrame:
        _, values, _ = spectrum(*_merged(x))
        share = np.cumsum(values) / values.sum()
        return pd.DataFrame([(c, float(share[min(c, len(share)) - 1])) for c in counts], columns=["components", "explained"])

    return states(series.select(F.lit(0).alias("cluster_id"), "x")).groupBy("cluster_id").applyInPandas(each, "components int, explained double")


class Subspaces:
    """Fitted subspaces on the driver: at most k means and bases."""

    def __init__(self, frame: DataFrame):
        self._hold(frame.select("cluster_id", "mean", "basis", "explained", "residual_ss").collect())

    @classmethod
    def of_states(cls, found: DataFrame, m: int) -> tuple[Subspaces, float, int]:
        """The fitted subspaces, the sum of d and the mark over all clusters, those without a subspace too."""
        rows, out = fit_states(found, m).collect(), cls.__new__(cls)
        out._hold([r for r in rows if r["mean"] is not None])
        return out, float(sum(r["d"] for r in sorted(rows, key=lambda r: r["cluster_id"]))), reduce(xor, (r["mark"] for r in rows), 0)

    def _hold(self, rows: list[Row]) -> None:
        rows = sorted(rows, key=lambda r: r["cluster_id"])
        self.ids = np.array([r["cluster_id"] for r in rows], np.int64)
        self.means = [np.array(r["mean"]) for r in rows]
        self.bases = [np.array(r["basis"]).reshape(-1, len(r["mean"])) for r in rows]
        self.explained = {r["cluster_id"]: r["explained"] for r in rows}
        self.cost = float(sum(r["residual_ss"] for r in rows))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each row to each subspace, in order of ids."""
        out = np.empty((len(x), len(self.ids)))
        for k, (mean, basis) in enumerate(zip(self.means, self.bases, strict=True)):
            c = x - mean
            along = c @ basis.T
            whole = np.square(c).sum(1)
            out[:, k] = np.maximum(0, whole - np.square(along).sum(1))
            # where the difference cancels, the residual itself is taken
            exact = np.flatnonzero(out[:, k] < 1e-9 * whole)
            if len(exact):
                out[exact, k] = np.square(c[exact] - along[exact] @ basis).sum(1)
        return out


def distances(series: DataFrame, subspaces: Subspaces) -> DataFrame:
    """cell_id, clusters, d: the squared distances of each cell to all subspaces."""
    ids = subspaces.ids.astype(int).tolist()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                d = subspaces.distances(np.stack(f["x"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"cell_id": f["cell_id"], "clusters": [ids] * len(f), "d": list(d)})

    return series.select("cell_id", "x").mapInPandas(run, "cell_id long, clusters array<int>, d array<double>")


def nearest(series: DataFrame, subspaces: Subspaces) -> DataFrame:
    """cell_id, clusters, d and cluster_id: all distances, and the nearest subspace, ties to the least id."""
    return distances(series, subspaces).withColumn("cluster_id", F.get("clusters", F.array_position("d", F.array_min("d")).cast("int") - 1))


def rank_profile(found: DataFrame) -> DataFrame:
    """rank, d: the mean over cells of their distances in ascending order. found: as distances() gives it."""
    return found.select(F.posexplode(F.array_sort("d")).alias("rank", "d")).groupBy("rank").agg(F.avg("d").alias("d"))


def mean_distances(found: DataFrame) -> DataFrame:
    """cluster_id, d: the mean distance of all cells to each subspace."""
    at = found.select(F.explode(F.arrays_zip("clusters", "d")).alias("x"))
    return at.groupBy(F.col("x.clusters").alias("cluster_id")).agg(F.avg("x.d").alias("d"))


def assign(series: DataFrame, subspaces: Subspaces) -> DataFrame:
    """cell_id, cluster_id, d: the nearest subspace of each cell, ties to the least id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f) and len(subspaces.ids):
                d = subspaces.distances(np.stack(f["x"].to_numpy()).astype(np.float64))
                best = d.argmin(axis=1)
                yield pd.DataFrame({"cell_id": f["cell_id"], "cluster_id": subspaces.ids[best].astype(np.int32), "d": d[np.arange(len(d)), best]})

    return series.select("cell_id", "x").mapInPandas(run, "cell_id long, cluster_id int, d double")


def _flat(lists: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list of arrays (or None), with the row that each comes from."""
    held = [(r, x) for r, x in enumerate(lists) if x is not None and len(x)]
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.repeat([r for r, _ in held], [len(x) for _, x in held]), np.concatenate([x for _, x in held]).astype(np.int64)


def _boundary(x: np.ndarray, labels: np.ndarray, at: np.ndarray, others: np.ndarray, subspaces: Subspaces) -> tuple[np.ndarray, np.ndarray]:
    """(new label, its squared distance) of each row. others: labels of neighbours of the rows at; labels all have a subspace."""
    d = subspaces.distances(x)
    open_ = np.zeros(d.shape, bool)
    known = np.isin(others, subspaces.ids)
    open_[at[known], np.searchsorted(subspaces.ids, others[known])] = True
    own, at = np.searchsorted(subspaces.ids, labels), np.arange(len(d))
    open_[at, own] = False
    there = np.where(open_, d, np.inf)
    best = there.argmin(axis=1)
    to = np.where(there[at, best] < d[at, own], best, own)
    return subspaces.ids[to], d[at, to]


def move_boundary(labelled: DataFrame, subspaces: Subspaces) -> DataFrame:
    """cell_id, cluster_id, was, d after one synchronous step. labelled: cell_id, cluster_id, x and clusters (labels of neighbours, null inside a cluster).

    A cell moves to the neighbouring cluster whose subspace is strictly nearer than its own, of equals
    to the least id. Cells whose own cluster has no subspace are dropped.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["cluster_id"].isin(subspaces.ids)]
            if len(f):
                was = f["cluster_id"].to_numpy().astype(np.int64)
                labels, d = _boundary(np.stack(f["x"].to_numpy()).astype(np.float64), was, *_flat(f["clusters"]), subspaces)
                yield pd.DataFrame({"cell_id": f["cell_id"], "cluster_id": labels.astype(np.int32), "was": was.astype(np.int32), "d": d})

    return labelled.select("cell_id", "cluster_id", "x", "clusters").mapInPandas(run, "cell_id long, cluster_id int, was int, d double")


#: Cells of a block.
BLOCK = 16_384


def blocked(series: DataFrame, edges: DataFrame | None = None, reach: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(block, cell_id, x, near, w, to; the number of blocks) of series (cell_id, x): cells by ranges of ids, in blocks that stay in their partitions.

    near: the neighbours of a cell by edges (src, dst), or those in its reach (src, dst, w: one way) with weights w; to:
    the blocks that need its label, its own first. Kept on the executors' disks with its lineage; the caller gives it up.
    """
    r = series.agg(F.count(F.lit(1)).alias("n"), F.min("cell_id").alias("a"), F.max("cell_id").alias("b")).first()
    blocks = max(1, min(int(r["n"]), max(series.sparkSession.sparkContext.defaultParallelism, -(-int(r["n"]) // BLOCK))))
    width = max(1, -(-((r["b"] or 0) - (r["a"] or 0) + 1) // blocks))
    block = lambda c: F.floor((F.col(c) - F.lit(r["a"] or 0)) / F.lit(width)).cast("int")
    none = F.array().cast("array<struct<dst:bigint,w:double>>")
    rows = series.select("cell_id", "x").withColumn("block", block("cell_id"))
    if edges is not None:
        reach = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("w", F.lit(1.0))
    if reach is None:
        rows = rows.select("block", "cell_id", "x", none.alias("links"), F.array("block").alias("to"))
    else:
        around = reach.groupBy(F.col("src").alias("cell_id")).agg(F.sort_array(F.collect_set(F.struct("dst", "w"))).alias("links"))
        asked = reach.groupBy(F.col("dst").alias("cell_id")).agg(F.collect_set(block("src")).alias("others"))
        rows = rows.join(around, "cell_id", "left").join(asked, "cell_id", "left")
        rows = rows.select("block", "cell_id", "x", F.coalesce("links", none).alias("links"), F.array_distinct(F.concat(F.array("block"), F.coalesce("others", F.array().cast("array<int>")))).alias("to"))
    rows = rows.select("block", "cell_id", "x", F.col("links.dst").alias("near"), F.col("links.w").alias("w"), "to")
    return rows.repartition(blocks, "block").sortWithinPartitions("block").persist(StorageLevel.DISK_ONLY), blocks


_ROUND = f"cell_id long, to array<int>, {_STATE}"


def _round_rows(cells: np.ndarray, to: pd.Series, fresh: np.ndarray, found: list[tuple]) -> pd.DataFrame:
    """Rows of _ROUND: one for each cell, then the states found. Whole columns at a time, since a Python object for each value took most of a round."""
    moved = pd.DataFrame({"cell_id": pd.array(cells, "Int64"), "to": to.to_numpy(), "cluster_id": pd.array(fresh, "Int64"), "s": None, "g": None})
    states = pd.DataFrame(found, columns=_COLUMNS).astype({"cluster_id": "Int64", "part": "Int64", "n": "Int64", "mark": "Int64"}).assign(to=None)
    return pd.concat([moved, states], ignore_index=True)[["cell_id", "to", *_COLUMNS]]


def boundary_round(held: DataFrame, labels: DataFrame, subspaces: Subspaces) -> DataFrame:
    """One synchronous step of move_boundary and the states of the new clusters, in the tasks that have the series.

    held: see blocked(); labels: cell_id, cluster_id, to. Rows with a cell_id are the new labels (with to);
    the others are states, whose mark is that of the cells that moved. Cells
    whose cluster has no subspace are dropped.
    """

    def run(known: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        label, empty = _known(known), no_rows("cell_id", "to", *_COLUMNS)
        if not len(f):
            return empty
        was = label(f["cell_id"].to_numpy())
        keep = np.isin(was, subspaces.ids)
        f, was = f[keep], was[keep]
        if not len(f):
            return empty
        at, others = _flat(f["near"])
        others = label(others)
        x, cells = np.stack(f["x"].to_numpy()).astype(np.float64), f["cell_id"].to_numpy()
        fresh, d = _boundary(x, was, at[others >= 0], others[others >= 0], subspaces)
        block, found = int(f["block"].iloc[0]), []
        for c in np.unique(fresh).tolist():
            own, moved = fresh == c, (fresh == c) & (fresh != was)
            found.append(State.of(x[own], float(d[own].sum()), marks(cells[moved], fresh[moved])).row(c, block))
        return _round_rows(cells, f["to"], fresh, found)

    return _sent(labels).groupBy("at").cogroup(held.groupBy("block")).applyInPandas(run, _ROUND)


def _known(known: pd.DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """The labels of cells, -1 for those without."""
    order = np.argsort(known["cell"].to_numpy(), kind="stable")
    ids, clusters = known["cell"].to_numpy()[order], known["label"].to_numpy().astype(np.int64)[order]

    def label(cells: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.full(len(cells), -1)
        at = np.minimum(np.searchsorted(ids, cells), len(ids) - 1)
        return np.where(ids[at] == cells, clusters[at], -1)

    return label


def assigned(held: DataFrame, subspaces: Subspaces) -> DataFrame:
    """cell_id, cluster_id, to: the nearest subspace of each cell of held (see blocked()), ties to the least id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f) and len(subspaces.ids):
                d = subspaces.distances(np.stack(f["x"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"cell_id": f["cell_id"], "cluster_id": subspaces.ids[d.argmin(axis=1)].astype(np.int32), "to": f["to"]})

    return held.select("cell_id", "x", "to").mapInPandas(run, "cell_id long, cluster_id int, to array<int>")


def _voted(own: np.ndarray, near: list, w: list, label: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The label with the most weight in reach of each cell, ties to its own, then to the least; its own where nothing is in reach."""
    lengths = np.array([len(x) for x in near], np.int64)
    at, others = np.repeat(np.arange(len(own)), lengths), label(np.concatenate(near).astype(np.int64))
    weight = np.concatenate(w).astype(np.float64)[others >= 0]
    at, others = at[others >= 0], others[others >= 0]
    names = np.unique(np.concatenate([own, others]))
    votes = np.bincount(at * len(names) + np.searchsorted(names, others), weight, len(own) * len(names)).reshape(len(own), -1).round(12)
    most = votes.max(axis=1)
    mine = votes[np.arange(len(own)), np.searchsorted(names, own)]
    return np.where(mine == most, own, names[votes.argmax(axis=1)])


def smooth_round(held: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels smoothed over the reach in held, and the states of the new clusters, in the tasks that have the series. Rows as boundary_round() gives them; the mark of a state is that of its cells."""

    def run(known: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        label = _known(known)
        f = f[label(f["cell_id"].to_numpy()) >= 0] if len(f) else f
        if not len(f):
            return no_rows("cell_id", "to", *_COLUMNS)
        x, cells = np.stack(f["x"].to_numpy()).astype(np.float64), f["cell_id"].to_numpy()
        fresh, block = _voted(label(cells), list(f["near"]), list(f["w"]), label), int(f["block"].iloc[0])
        found = [State.of(x[fresh == c], 0.0, marks(cells[fresh == c], fresh[fresh == c])).row(c, block) for c in np.unique(fresh).tolist()]
        return _round_rows(cells, f["to"], fresh, found)

    return _sent(labels).groupBy("at").cogroup(held.groupBy("block")).applyInPandas(run, _ROUND)


def _sent(labels: DataFrame) -> DataFrame:
    """Labels (cell_id, cluster_id, to) for each block that needs them, under names of their own, since they may stem from the table that has the series."""
    return labels.select(F.explode("to").alias("at"), F.col("cell_id").alias("cell"), F.col("cluster_id").alias("label"))


def labelled_states(held: DataFrame, labels: DataFrame, blocks: int) -> DataFrame:
    """As states(), of series in blocks: only labels (cell_id, cluster_id, to) move."""

    def run(known: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return no_rows(*_COLUMNS)
        cells = f["cell_id"].to_numpy()
        given = _known(known)(cells)
        x, block = np.stack(f["x"].to_numpy()).astype(np.float64), int(f["block"].iloc[0])
        rows = [State.of(x[given == c], 0.0, marks(cells[given == c], given[given == c])).row(c, block) for c in np.unique(given[given >= 0]).tolist()]
        return pd.DataFrame(rows, columns=_COLUMNS, dtype=object)

    found = _sent(labels).groupBy("at").cogroup(held.select("block", "cell_id", "x").groupBy("block")).applyInPandas(run, _STATE)
    return _merge_parts(found, blocks > 4 * FAN)


def round_states(found: DataFrame, blocks: int) -> DataFrame:
    """The states that a boundary round gives."""
    return _merge_parts(found.where("cell_id is null").select(*_COLUMNS), blocks > 4 * FAN)
