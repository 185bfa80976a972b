"""Whole loops against the same loops in NumPy, and what a round costs."""

import numpy as np
import pandas as pd
import pytest

from fieldloom.config import STRATEGIES
from fieldloom.lineage import cut
from fieldloom.operators import lowrank, smoothing, stencil
from fieldloom.operators.reconnect import merge_small
from fieldloom.operators.smoothing import smooth_labels
from fieldloom.plans import refine

COLUMNS = 10


def start(seed=0, rows=9, noise=0.35, clusters=4, wrong=0.25):
    """Cells of four regions on lines of their own; some labels are wrong."""
    rng = np.random.default_rng(seed)
    n, t = rows * COLUMNS, 6
    truth = np.array([(k // COLUMNS) // 5 * 2 + (k % COLUMNS) // 5 for k in range(n)])
    lines = rng.normal(size=(clusters, t))
    x = lines[truth] * rng.normal(size=(n, 1)) * 2 + noise * rng.normal(size=(n, t)) + truth[:, None]
    labels = np.where(rng.random(n) < wrong, rng.integers(0, clusters, n), truth)
    return x, labels


class Loop:
    """The four strategies on arrays."""

    def __init__(self, spark, x, grid):
        self.x, self.grid, self.spark = x, grid, spark
        pairs = lambda f: [tuple(r) for r in f.collect()]
        self.edges, self.four = pairs(grid.edges), pairs(grid.edges_four)

    def fit(self, labels, m):
        """cluster to (mean, basis); the cost."""
        out, cost = {}, 0.0
        for c in sorted(set(labels.values())):
            x = self.x[[k for k in labels if labels[k] == c]]
            if len(x) > m:
                u = x - x.mean(0)
                _, s, vt = np.linalg.svd(u, full_matrices=False)
                out[c] = (x.mean(0), vt[:m])
                cost += np.square(s[m:]).sum()
        return out, cost

    def distances(self, spaces):
        d = []
        for mean, basis in spaces.values():
            u = self.x - mean
            d.append(np.square(u - u @ basis.T @ basis).sum(1))
        return np.stack(d, axis=1), list(spaces)

    def reconnect(self, labels, spaces, k):
        d, ids = self.distances(spaces)
        cells = np.array(sorted(labels))
        return merge_small(cells, np.array([labels[c] for c in cells]), d[cells], ids, self.edges, k)

    def refine(self, labels, strategy, m, k, half_width):
        spaces, cost = self.fit(labels, m)
        trajectory, bar, best = [cost], cost, None
        for _ in range(6):
            d, ids = self.distances(spaces)
            fresh = {c: ids[j] for c, j in enumerate(d.argmin(axis=1))}
            same = fresh == labels
            if strategy == "iter_merge":
                fresh = self.reconnect(fresh, spaces, k)
            elif strategy == "smooth_merge":
                frame = self.spark.createDataFrame(list(fresh.items()), "cell_id long, cluster_id int")
                fresh = {r["cell_id"]: r["cluster_id"] for r in smooth_labels(frame, self.grid.series, self.grid.places, half_width, COLUMNS).collect()}
            labels = fresh
            spaces, cost = self.fit(labels, m)
            trajectory.append(cost)
            if cost < bar:
                bar, best = cost, (labels, spaces)
            if same:
                break
        if best and strategy != "iter_merge":
            best = (self.reconnect(*best, k), None)
        return trajectory, best and best[0]

    def integrated(self, labels, m, k):
        near = {}
        for a, b in self.four:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        trajectory = []
        for _ in range(6):
            spaces, _ = self.fit(labels, m)
            d, ids = self.distances(spaces)
            fresh, cost = {}, 0.0
            for c, own in labels.items():
                if own in spaces:
                    options = sorted({labels[o] for o in near.get(c, ()) if o in labels} & set(spaces) - {own})
                    to = min(options, key=lambda j: d[c, ids.index(j)], default=own)
                    fresh[c] = to if d[c, ids.index(to)] < d[c, ids.index(own)] else own
                    cost += d[c, ids.index(fresh[c])]
            moved = any(fresh[c] != labels[c] for c in fresh)
            labels = fresh
            trajectory.append(cost)
            if not moved:
                break
        return trajectory, self.reconnect(labels, spaces, k)


def grid_of(spark, x):
    rows = [(k, k // COLUMNS, k % COLUMNS, 0.5 * (k // COLUMNS), 0.5 * (k % COLUMNS), v.tolist()) for k, v in enumerate(x)]
    series = cut(spark.createDataFrame(rows, "cell_id long, lat_idx int, lon_idx int, latitude double, longitude double, x array<double>").repartition(3))
    return refine.Grid(series, cut(stencil.neighbours(series)), cut(stencil.neighbours(series, stencil.FOUR)), cut(series.select("lat_idx", "lon_idx", "latitude", "longitude")), COLUMNS)


@pytest.mark.parametrize("m", [1, 2])
@pytest.mark.parametrize("strategy", STRATEGIES)
def test_trajectories_equal_the_loop_in_numpy(spark, strategy, m, monkeypatch):
    monkeypatch.setattr(lowrank, "BLOCK", 11)  # several blocks, whose borders cut through clusters
    x, labels = start(m)
    grid = grid_of(spark, x)
    given = spark.createDataFrame([(k, int(c)) for k, c in enumerate(labels)], "cell_id long, cluster_id int")
    got = refine.run(grid, given, strategy, m, 4, max_iter=6, half_width=60.0)
    loop, by_cell = Loop(spark, x, grid), dict(enumerate(labels.tolist()))
    trajectory, best = loop.integrated(by_cell, m, 4) if strategy == "integrated" else loop.refine(by_cell, strategy, m, 4, 60.0)
    assert [c for _, c in got.trajectory] == pytest.approx(trajectory, rel=1e-9)
    assert len(trajectory) > 1
    assert {r["cell_id"]: r["cluster_id"] for r in got.labels.collect()} == best


def test_labels_from_the_table_of_series(spark):
    """Labels and series that stem from one table, as in the queries."""
    x, labels = start(5)
    series = grid_of(spark, x).series.join(spark.createDataFrame([(k, int(c)) for k, c in enumerate(labels)], "cell_id long, cluster_id int"), "cell_id")
    series = cut(series)
    grid = refine.Grid(series, cut(stencil.neighbours(series)), cut(stencil.neighbours(series, stencil.FOUR)), series.select("lat_idx", "lon_idx", "latitude", "longitude"), COLUMNS)
    got = refine.run(grid, series.select("cell_id", "cluster_id"), "integrated", 1, 4, max_iter=2)
    assert got.labels.count() == len(x)


@pytest.mark.parametrize(("strategy", "most"), [("post_merge", 3), ("integrated", 4)])
def test_jobs_of_a_round(spark, strategy, most):
    x, labels = start(7, noise=1.5, wrong=0.7)
    grid = grid_of(spark, x)
    given = cut(spark.createDataFrame([(k, int(c)) for k, c in enumerate(labels)], "cell_id long, cluster_id int"))
    jobs, context = {}, spark.sparkContext
    for rounds in (1, 3):
        context.setJobGroup(f"{strategy}-{rounds}", "rounds")
        got = refine.run(grid, given, strategy, 1, 4, max_iter=rounds)
        assert got.n_iter == rounds
        jobs[rounds] = len(context.statusTracker().getJobIdsForGroup(f"{strategy}-{rounds}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[3] - jobs[1] <= 2 * most, jobs


def test_blocks_stay_where_they_are(spark):
    """The series of a boundary round don't go through an exchange; labels do."""
    x, labels = start(3)
    grid = grid_of(spark, x)
    held, _ = lowrank.blocked(grid.series, grid.edges_four)
    given = spark.createDataFrame([(k, int(c)) for k, c in enumerate(labels)], "cell_id long, cluster_id int")
    spaces = refine.fitted(grid, given, 1)
    now = cut(given.join(held.select("cell_id", "to"), "cell_id"))
    plan = lowrank.boundary_round(held, now, spaces)._jdf.queryExecution().executedPlan().toString()
    held.unpersist()
    outside = plan.split("InMemoryRelation")[0]
    assert outside.count("Exchange hashpartitioning") == 1


def test_labels_alone_move_in_rounds_of_smoothing_and_merging(spark, monkeypatch):
    """As the boundary round: one exchange, of labels; states are those of a pass over labelled series."""
    monkeypatch.setattr(lowrank, "BLOCK", 11)
    x, labels = start(3)
    grid = grid_of(spark, x)
    given = spark.createDataFrame([(k, int(c)) for k, c in enumerate(labels)], "cell_id long, cluster_id int")
    held, blocks = lowrank.blocked(grid.series, reach=smoothing.label_reach(grid.series, grid.places, 60.0, COLUMNS))
    now = cut(given.join(held.select("cell_id", "to"), "cell_id"))
    smooth = lowrank.smooth_round(held, now)
    same = lowrank.labelled_states(held, now, blocks)
    plans = [f._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0] for f in (smooth, same)]
    want = {(r["cell_id"], r["cluster_id"]) for r in smooth_labels(given, grid.series, grid.places, 60.0, COLUMNS).collect()}
    assert {(r["cell_id"], r["cluster_id"]) for r in smooth.where("cell_id is not null").collect()} == want
    got, plain = (lowrank.Subspaces.of_states(f, 1) for f in (same, lowrank.states(grid.series.join(given, "cell_id").select("cell_id", "x", "cluster_id"))))
    held.unpersist()
    assert plans[0].count("Exchange hashpartitioning(at") == 1 and plans[0].count("Exchange") == 1
    assert plans[1].count("Exchange hashpartitioning(at") == 1
    assert got[0].cost == pytest.approx(plain[0].cost) and got[2] == plain[2]


def test_states_of_few_cells_hold_series(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 12))
    one, two = lowrank.State.of(x[:5]), lowrank.State.of(x[5:9])
    one.add(two)
    assert one.held.shape == (9, 12) and one.gram == pytest.approx(x[:9].T @ x[:9])
    one.add(lowrank.State.of(x[9:]))
    assert one.held.shape == (12, 12) and one.gram == pytest.approx(x.T @ x)


def test_boundary_goes_by_whole_columns():
    rng = np.random.default_rng(3)
    spaces = lowrank.Subspaces.__new__(lowrank.Subspaces)
    spaces.ids, spaces.means, spaces.bases = np.array([1, 4, 7]), list(rng.normal(size=(3, 5))), [np.linalg.qr(rng.normal(size=(5, 2)))[0].T for _ in range(3)]
    x, labels = rng.normal(size=(200, 5)), rng.choice(spaces.ids, 200)
    near = [None if i % 9 == 0 else rng.choice([1, 4, 7, 9], i % 5) for i in range(200)]
    to, d = lowrank._boundary(x, labels, *lowrank._flat(near), spaces)
    every = spaces.distances(x)
    for i in range(200):
        own = int(np.searchsorted(spaces.ids, labels[i]))
        others = sorted({k for k, c in enumerate(spaces.ids) if k != own and near[i] is not None and c in near[i]}, key=lambda k: (every[i, k], k))
        want = others[0] if others and every[i, others[0]] < every[i, own] else own
        assert to[i] == spaces.ids[want] and d[i] == every[i, want]
    rows = lowrank._round_rows(np.array([2**60 + 1, 3]), pd.Series([np.array([0]), np.array([0, 1])]), np.array([4, 7]), [lowrank.State.of(x[:2], 0.5, -(2**62) - 1).row(4, 0)])
    assert rows["cell_id"].iloc[0] == 2**60 + 1 and rows["cell_id"].isna().tolist() == [False, False, True]
    assert rows["mark"].iloc[2] == -(2**62) - 1 and rows["to"].iloc[2] is None and rows["s"].iloc[0] is None
