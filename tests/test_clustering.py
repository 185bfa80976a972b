import math

import numpy as np
import pandas as pd
import pytest

from fieldloom.config import STRATEGIES, Field, Initial, Refinement, Run, seed_everything
from fieldloom.lineage import cut
from fieldloom.operators import agglomeration, centroids, lowrank, modes, pairs, stencil
from fieldloom.operators.reconnect import merge_small
from fieldloom.plans import pipeline, refine
from fieldloom.sources import sinks


def series_frame(spark, x, n_lon):
    rows = [(k, k // n_lon, k % n_lon, float(k // n_lon), float(k % n_lon), v) for k, v in enumerate(np.asarray(x, float).tolist())]
    return spark.createDataFrame(rows, "cell_id long, lat_idx int, lon_idx int, latitude double, longitude double, x array<double>")


def label_frame(spark, labels):
    return spark.createDataFrame([(k, int(c)) for k, c in enumerate(labels)], "cell_id long, cluster_id int")


def labelled(spark, x, labels):
    return series_frame(spark, x, len(x)).join(label_frame(spark, labels), "cell_id")


def planted(seed=0, n=60, t=12, k=3, m=2, noise=0.05):
    """Contiguous rows of cells, each in a plane of its own."""
    rng = np.random.default_rng(seed)
    out, labels = [], []
    for c in range(k):
        basis, mean = np.linalg.qr(rng.normal(size=(t, m)))[0].T, 3 * rng.normal(size=t)
        out.append(mean + rng.normal(size=(n // k, m)) @ basis * 2 + noise * rng.normal(size=(n // k, t)))
        labels += [c] * (n // k)
    return np.concatenate(out), np.array(labels)


# --- subspaces ---------------------------------------------------------------------------------------------


def test_fit_equals_svd(spark):
    x, labels = planted()
    spaces = {r["cluster_id"]: r for r in lowrank.fit(labelled(spark, x, labels), 2).collect()}
    for c in range(3):
        y = x[labels == c]
        centred = y - y.mean(0)
        s = np.linalg.svd(centred, compute_uv=False) ** 2
        assert spaces[c]["explained"] == pytest.approx(s[:2].sum() / s.sum())
        assert spaces[c]["residual_ss"] == pytest.approx(s[2:].sum())
        basis = np.array(spaces[c]["basis"])
        assert basis @ basis.T == pytest.approx(np.eye(2), abs=1e-9)
        assert spaces[c]["residual_ss"] == pytest.approx((np.square(centred).sum() - np.square(centred @ basis.T).sum()))
    found = {r["m"]: r["cost"] for r in lowrank.costs(labelled(spark, x, labels), [1, 2, 5, 12]).collect()}
    assert found[2] == pytest.approx(sum(s["residual_ss"] for s in spaces.values()))
    assert found[1] >= found[2] >= found[5] >= found[12]


def test_small_and_collinear_clusters(spark):
    x = np.array([[0.0, 0, 0], [1, 1, 1], [2, 2, 2], [3, 3, 3], [9, 0, 0]])
    data = labelled(spark, x, [0, 0, 0, 0, 1])
    rows = lowrank.fit(data, 1).collect()
    assert [r["cluster_id"] for r in rows] == [0] and rows[0]["explained"] == pytest.approx(1)
    assert lowrank.fit(data, 5).count() == 0
    got = lowrank.costs(data, [1]).first()
    assert got["n_unfitted"] == 1 and got["cost"] == pytest.approx(0, abs=1e-9)
    with pytest.raises(Exception, match="finite"):
        lowrank.fit(labelled(spark, np.full((4, 3), np.nan), [0] * 4), 1).collect()


def spaces_of(spark, rows):
    doubles = lambda x: [float(v) for v in x]
    frame = spark.createDataFrame([(c, 9, doubles(mean), [doubles(b) for b in basis], 1.0, 1.0, 0.0) for c, mean, basis in rows], lowrank.SUBSPACES)
    return lowrank.Subspaces(frame)


def test_assignment(spark):
    z = [0.0] * 4
    axes = np.eye(4).tolist()
    spaces = spaces_of(spark, [(0, z, axes[:3]), (1, z, [axes[0], axes[1], axes[3]]), (2, z, [axes[0], axes[2], axes[3]]), (3, [4.0, 0, 3.0, 0.0], [axes[0], axes[1], axes[3]])])
    assert lowrank.assign(series_frame(spark, [[4, 1, 3, 5]], 1), spaces).first()["cluster_id"] == 3
    units = spaces_of(spark, [(0, [0.0] * 3, [[1.0, 0, 0]]), (1, [0.0] * 3, [[0, 1.0, 0]])])
    two = series_frame(spark, [[1e3, 0, 0], [0, 2e3, 0]], 2)
    got = lowrank.assign(two, units)
    assert {r["cell_id"]: (r["cluster_id"], r["d"]) for r in got.collect()} == {0: (0, 0.0), 1: (1, 0.0)}
    assert refine._mark(got) == refine._mark(label_frame(spark, [0, 1]).repartition(2)) != refine._mark(label_frame(spark, [1, 0]))
    tie = lowrank.assign(series_frame(spark, [[1, 1, 0]], 1), units).first()
    assert tie["cluster_id"] == 0


def test_boundary_cells_move(spark):
    units = spaces_of(spark, [(0, [0.0] * 2, [[1.0, 0]]), (1, [0.0] * 2, [[0, 1.0]])])
    series = series_frame(spark, [[5, 0], [0, 5], [0, 5]], 3)
    labels = label_frame(spark, [0, 0, 1])
    from fieldloom.operators.graph import neighbouring_clusters

    near = series.join(labels, "cell_id").join(neighbouring_clusters(labels, stencil.neighbours(series, stencil.FOUR)), "cell_id", "left")
    got = {r["cell_id"]: (r["cluster_id"], r["was"]) for r in lowrank.move_boundary(near, units).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (1, 1)}
    only = spaces_of(spark, [(0, [0.0] * 2, [[1.0, 0]])])
    assert {r["cell_id"] for r in lowrank.move_boundary(near, only).collect()} == {0, 1}  # cells of unfitted clusters go


# --- agglomeration -------------------------------------------------------------------------------------------


def brute_average(d):
    groups = {i: [i] for i in range(len(d))}
    heights = []
    while len(groups) > 1:
        h, a, b = min((d[np.ix_(groups[i], groups[j])].mean(), i, j) for i in groups for j in groups if i < j)
        heights.append((h, a, b))
        groups[a] += groups.pop(b)
    return heights


@pytest.mark.parametrize("kernel", [10**9, 8])
def test_average_linkage_equals_one_merge_at_a_time(spark, kernel):
    x = np.random.default_rng(3).normal(size=(40, 4))
    series = series_frame(spark, x, 8)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    merges = sorted(tuple(r) for r in agglomeration.average_linkage_merges(pairs.all_pairs(series, "euclidean"), series, kernel).collect())
    want = brute_average(d)
    assert [h for h, _, _ in merges] == pytest.approx([h for h, _, _ in want])
    for k in (3, 10):
        a, b = (agglomeration.cut_tree(range(40), m, [k])[k] for m in (merges, want))
        assert a == b


def test_average_linkage_of_few_cells():
    d = np.array([[np.nan, 1, 2], [1, np.nan, 3], [2, 3, np.nan]])
    merges = agglomeration.average_linkage(np.arange(3), np.ones(3), d)
    assert merges == [(1.0, 0, 1), (2.5, 0, 2)]
    assert set(agglomeration.cut_tree(range(3), merges, [1])[1].values()) == {0}
    i = np.arange(20)
    merges = agglomeration.average_linkage(i, np.ones(20), (i[:, None] + i[None]).astype(float))
    assert len(set(agglomeration.cut_tree(range(20), merges, [3])[3].values())) == 3
    apart = np.full((3, 3), np.nan)
    apart[0, 1] = apart[1, 0] = 1
    assert agglomeration.average_linkage(np.arange(3), np.ones(3), apart) == [(1.0, 0, 1)]


def test_constrained_linkage(spark):
    full = {(a, b): float(a + b) for a in range(4) for b in range(a + 1, 4)}
    for edges in (full, {(0, 1): 1.0, (1, 2): 2.0, (2, 3): 3.0}):
        merges = agglomeration.constrained_merges(dict.fromkeys(range(4), 1), edges)
        assert len(merges) == 3
        assert set(agglomeration.in_sequence(range(4), merges, [1])[1].values()) == {0}
    merges = agglomeration.constrained_merges({0: 1, 1: 1, 2: 1}, {(0, 1): 1.0, (0, 2): 5.0, (1, 2): 7.0})
    assert merges == [(1.0, 0, 1), (6.0, 0, 2)]
    frame = spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, d double")
    got = agglomeration.constrained(frame, spark.range(3).withColumnRenamed("id", "cell_id"), [1, 2])
    assert {r["k"] for r in got.collect()} == {2}  # two pieces never become one


def test_constrained_linkage_with_missing_links_made_up(spark):
    x = [[0.0], [1.0], [5.0], [9.0]]
    series = series_frame(spark, x, 4)
    total = agglomeration.paired_sum(series.toPandas(), "euclidean")
    assert total([0, 1], [2]) == 5.0 and total([0, 1], [2, 3]) == 13.0
    edges = {(0, 1): 1.0, (1, 2): 4.0, (2, 3): 4.5}
    plain = agglomeration.constrained_merges(dict.fromkeys(range(4), 1), edges)
    assert plain == [(1.0, 0, 1), (4.0, 0, 2), (4.5, 0, 3)]
    # after 0 and 1 merge, 2 is at (5 * 1 + 4 * 1) / 2
    made_up = agglomeration.constrained_merges(dict.fromkeys(range(4), 1), edges, total)
    assert made_up[:2] == [(1.0, 0, 1), (4.5, 0, 2)] and len(made_up) == 3


def test_ward_takes_the_least_growth():
    x = {k: np.array([v]) for k, v in enumerate([0.0, 0.1, 5.0, 5.2, 20.0])}
    merges = agglomeration.ward_merges(x, [(0, 1), (1, 2), (2, 3), (3, 4)])
    groups = [[0], [1], [2], [3], [4]]
    ss = lambda g: np.square(np.array([x[i][0] for i in g]) - np.mean([x[i][0] for i in g])).sum()
    for d, _, _ in merges:
        grown = [(ss(a + b) - ss(a) - ss(b), i) for i, (a, b) in enumerate(zip(groups, groups[1:], strict=False))]
        best, i = min(grown)
        assert d == pytest.approx(best)
        groups[i : i + 2] = [groups[i] + groups[i + 1]]


# --- centroids -------------------------------------------------------------------------------------------------


def test_kmeans(spark):
    x, labels = planted(1, noise=0.01)
    series = series_frame(spark, x, 10)
    got = centroids.objective(labelled(spark, x, labels)).collect()
    for r in got:
        y = x[labels == r["cluster_id"]]
        assert r["objective"] == pytest.approx(np.square(y - y.mean(0)).sum())
    found, centres = centroids.lloyd(series, x[[0, 20, 40]])
    back = np.array([r["cluster_id"] for r in found.orderBy("cell_id").collect()])
    d = np.square(x[:, None] - centres[None]).sum(2)
    assert (d.argmin(1) == back).all()
    assert centroids.kmeans(series, 3).select("cluster_id").distinct().count() == 3
    same = series_frame(spark, np.ones((5, 3)), 5)
    assert centroids.kmeans(same, 3).select("cluster_id").distinct().count() == 1


# --- contiguity --------------------------------------------------------------------------------------------------


def n_components(labels, edges):
    parent = {c: c for c in labels}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for a, b in edges:
        if a in labels and b in labels and labels[a] == labels[b]:
            parent[find(a)] = find(b)
    return len({find(c) for c in labels})


@pytest.mark.parametrize("seed", range(4))
def test_reconnecting_leaves_at_most_k_components(seed):
    rng = np.random.default_rng(seed)
    n = 8
    at = np.arange(n * n).reshape(n, n)
    edges = [(int(a), int(b)) for a, b in [*zip(at[:, :-1].ravel(), at[:, 1:].ravel(), strict=True), *zip(at[:-1].ravel(), at[1:].ravel(), strict=True)]]
    labels = rng.integers(0, 4, n * n)
    out = merge_small(at.ravel(), labels, rng.random((n * n, 4)), [0, 1, 2, 3], edges, 5)
    assert n_components(out, edges) <= 5 and len(out) == n * n
    assert n_components(out, edges) == len(set(out.values()))  # a label for each component


def test_reconnecting_small_cases():
    # of equally small components the one with the least cell goes first; without a subspace nearby the least neighbour wins
    out = merge_small(np.arange(3), np.array([0, 1, 0]), np.zeros((3, 1)), [0], [(0, 1), (1, 2)], 1)
    assert out == {0: 1, 1: 1, 2: 1}
    # an isolated cell is dropped
    assert merge_small(np.arange(3), np.array([0, 0, 1]), np.zeros((3, 1)), [0], [(0, 1)], 1) == {0: 0, 1: 0}
    # the vote decides, and a second component of a cluster gets the least free id
    d = np.array([[0.0, 9], [0, 9], [9, 0], [9, 0], [0, 9]])
    out = merge_small(np.arange(5), np.array([0, 0, 2, 1, 0]), d, [0, 1], [(0, 1), (1, 2), (2, 3), (3, 4)], 3)
    assert out == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


# --- loops -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_strategies_lower_the_cost(spark, strategy):
    x, truth = planted(2)
    series = series_frame(spark, x, 10)
    labels = truth.copy()
    labels[[18, 19, 20, 21, 38, 41]] = [1, 1, 0, 0, 2, 1]
    places = series.select("lat_idx", "lon_idx", "latitude", "longitude")
    grid = refine.Grid(cut(series), cut(stencil.neighbours(series)), cut(stencil.neighbours(series, stencil.FOUR)), cut(places), 10)
    got = refine.run(grid, label_frame(spark, labels), strategy, 2, 3, 6, half_width=20.0)
    if strategy == "integrated":  # its steps lower the cost; contiguity at the end may raise it
        assert got.trajectory[-1][1] < got.trajectory[0][1] and got.best_cost is not None
    else:
        assert got.best_cost is not None and got.best_cost < got.start_cost
    found = {r["cell_id"]: r["cluster_id"] for r in got.labels.collect()}
    edges = [tuple(r) for r in grid.edges.collect()]
    assert n_components(found, edges) <= 3 and len(found) == 60
    frame = got.trajectory_frame(spark)
    assert refine.best_iterations(frame).count() == 1
    assert refine.results_frame(spark, [got]).first()["start_cost"] == pytest.approx(got.start_cost)


def test_no_improvement_gives_no_labels(spark):
    x, truth = planted(3, noise=0.001)
    series = series_frame(spark, x, 10)
    grid = refine.Grid(series, stencil.neighbours(series), stencil.neighbours(series, stencil.FOUR), series.select("lat_idx", "lon_idx", "latitude", "longitude"), 10)
    got = refine.run(grid, label_frame(spark, truth), "post_merge", 2, 3)
    assert got.labels is None and got.best_cost is None and got.n_iter == 1


# --- modes, angles, runs ---------------------------------------------------------------------------------------------


def test_angles(spark):
    assert modes.principal_angles(np.eye(4)[:2], np.eye(4)[2:]) == pytest.approx([90, 90])
    assert modes.principal_angles(np.eye(3)[:1], np.array([[1.0, 1, 0]])) == pytest.approx([45])
    spaces = spark.createDataFrame([(0, 9, [0.0] * 3, [[1.0, 0.0, 0.0]], 1.0, 1.0, 0.0), (1, 9, [0.0] * 3, [[1.0, 1.0, 0.0]], 1.0, 1.0, 0.0), (2, 9, [0.0] * 3, [[0.0, 0.0, 1.0]], 1.0, 1.0, 0.0)], lowrank.SUBSPACES)
    found = modes.angle_summary(modes.angles(spaces))
    got = {(r["c1"], r["c2"]): r for r in found.collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)}
    assert got[0, 1]["largest"] == pytest.approx(45) and got[0, 1]["chordal"] == pytest.approx(math.sqrt(0.5)) and got[0, 2]["mean_angle"] == pytest.approx(90)
    matrix = sinks.similarity_matrix(found, "largest").toPandas().set_index("c1").to_numpy()
    assert matrix == pytest.approx(matrix.T) and np.diag(matrix) == pytest.approx([0, 0, 0])


def test_modes_equal_svd(spark):
    x, labels = planted(4)
    data = labelled(spark, x, labels)
    found = modes.cluster_modes(data)
    maps = modes.mode_maps(data, found).toPandas()
    for c in range(3):
        u, s, vt = np.linalg.svd(x[labels == c], full_matrices=False)
        for m in (1, 2):
            pc = found.where(f"cluster_id = {c} and mode = {m}").orderBy("t").toPandas()["pc"].to_numpy()
            assert np.abs(pc @ vt[m - 1]) == pytest.approx(s[m - 1])
            eof = maps[(maps["cluster_id"] == c) & (maps["mode"] == m)].sort_values("cell_id")["eof"].to_numpy()
            assert np.abs(eof @ u[:, m - 1]) == pytest.approx(1)
    whole = modes.field_mode(data).orderBy("t").toPandas()["value"].to_numpy()
    assert np.abs(whole @ np.linalg.svd(x - x.mean(0))[2][0]) == pytest.approx(1)
    assert modes.cluster_modes(labelled(spark, x[:1], [0])).count() == 0


def test_settings():
    assert Field().random_seed == 13 and Field().resolution == 2 and Refinement().dimensions == (5, 10, 15, 30) and Initial().n_clusters == (25,)
    assert Field(half_width=300, output_path="o").filtered_path == "o/filtered/sla_300km"
    assert Initial(method="ward_connected").effective_metric == "euclidean"
    with pytest.raises(ValueError):
        Initial(method="other")
    with pytest.raises(ValueError):
        Refinement(strategies=("other",))
    assert Run().key("a") == Run().key("a") != Run(field=Field(half_width=1)).key("a")
    draws = []
    for _ in range(2):
        seed_everything(5)
        draws.append(np.random.random(3).tolist())
    assert draws[0] == draws[1]


@pytest.mark.parametrize("method", ["agglomerative", "agglomerative_connected", "k_means_connected", "ward_connected"])
def test_initial_clusterings(spark, method):
    x, _ = planted(5)
    series = cut(series_frame(spark, x, 10))
    got = pipeline.initial_labels(series, Run(initial=Initial(method=method, metric="euclidean", n_clusters=(3, 5))), 10, wrap=False)
    frame = got.toPandas()
    assert set(frame["k"]) == {3, 5}
    for k, part in frame.groupby("k"):
        assert isinstance(part, pd.DataFrame) and len(part) == 60 and part["cluster_id"].nunique() <= k


def test_whole_run(spark, tmp_path):
    rng = np.random.default_rng(6)
    wave = rng.normal(size=(3, 10))
    rows = []
    for i in range(6):
        for j in range(10):
            for t in range(10):
                rows.append((i * 10 + j, i, j, t, 2.0 * i - 5, 2.0 * j - 9, float(wave[i // 2, t] + 0.1 * rng.normal())))
    field = spark.createDataFrame(rows, "cell_id long, lat_idx int, lon_idx int, t int, latitude double, longitude double, sla double")
    settings = Run(Field(output_path=str(tmp_path), half_width=100), Initial("ward_connected", n_clusters=(3,)), Refinement(n_clusters=3, dimensions=(1,), strategies=("post_merge", "integrated")))
    out = pipeline.run(spark, field, settings)
    assert out["results"].count() == 2
    assert out["initial"].select("cluster_id").distinct().count() == 3
    again = pipeline.run(spark, field, settings)
    assert again["initial"].exceptAll(out["initial"]).count() == 0


def test_ward_without_neighbours_equals_brute_force(spark):
    x = np.random.default_rng(8).normal(size=(24, 3))
    series = cut(series_frame(spark, x, 6))
    got = agglomeration.ward_unconstrained(pairs.all_pairs(series, "squared_euclidean"), series, [4]).toPandas()
    groups = [[k] for k in range(24)]
    ss = lambda g: np.square(x[g] - x[g].mean(0)).sum()
    while len(groups) > 4:
        _, a, b = min((ss(p + q) - ss(p) - ss(q), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
        groups[a] += groups.pop(b)
    assert {frozenset(g["cell_id"]) for _, g in got.groupby("cluster_id")} == {frozenset(g) for g in groups}


def test_whitening_and_alignment(spark):
    x, _ = planted(9)
    z = np.stack(modes.whitened(series_frame(spark, x, 10), 3).toPandas()["z"])
    assert np.cov(z.T) == pytest.approx(np.eye(3), abs=1e-8)
    mode = spark.createDataFrame([(0, 1.0), (1, 3.0)], "t int, pc double")
    times = spark.createDataFrame([(0, "2000-01-15"), (1, "2000-02-15")], "t int, ts string").selectExpr("t", "timestamp(ts) as ts")
    index = spark.createDataFrame([("2000-01-02", 0.5), ("2001-01-02", 9.0)], "ts string, anomaly double").selectExpr("timestamp(ts) as ts", "anomaly")
    assert [(r["pc"], r["value"]) for r in modes.against_index(mode, times, index).collect()] == [(-1.0, 0.5)]


def test_distance_profiles(spark):
    spaces = spaces_of(spark, [(0, [0, 0], [[1, 0]]), (1, [0, 0], [[0, 1]])])
    found = lowrank.distances(series_frame(spark, [[3, 1], [0, 2]], 2), spaces)
    assert [r["d"] for r in lowrank.rank_profile(found).orderBy("rank").collect()] == [0.5, 6.5]
    assert {r["cluster_id"]: r["d"] for r in lowrank.mean_distances(found).collect()} == {0: 2.5, 1: 4.5}
