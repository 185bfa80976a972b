import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions.geo import sigma
from fieldloom.operators import gradients, graph, masks, pairs, regrid, smoothing, stencil
from fieldloom.schema import FIELD
from fieldloom.sources import fields, sinks


def field(spark, values, lat0=0.0, lon0=0.0, step=1.0):
    """values[t][i][j] with None for gaps."""
    n_lon = len(values[0][0])
    rows = [(i * n_lon + j, i, j, t, lat0 + step * i, lon0 + step * j, v) for t, plane in enumerate(values) for i, row in enumerate(plane) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, FIELD)


def cells(spark, places):
    return spark.createDataFrame([(k, i, j, float(i), float(j)) for k, (i, j) in enumerate(places)], "cell_id long, lat_idx int, lon_idx int, latitude double, longitude double")


def edges_of(frame):
    return {tuple(r) for r in frame.collect()}


def test_smoothing_is_the_weighted_mean(spark):
    f = field(spark, [[[1.0, 4.0]], [[2.0, 5.0]], [[3.0, 6.0]]], step=0.1)
    places = f.select("lat_idx", "lon_idx", "latitude", "longitude").distinct()
    got = {(r["cell_id"], r["t"]): r["sla"] for r in smoothing.gauss_smooth(f, places, 10.0, 2).collect()}
    w = math.exp(-((6371.0088 * math.radians(0.1)) ** 2) / (2 * sigma(10.0) ** 2))
    for t in range(3):
        assert got[0, t] == pytest.approx(((1 + t) + w * (4 + t)) / (1 + w), abs=5e-5)


def test_smoothing_counts_gaps_as_zero_without_renormalising(spark):
    for other in ([None, None], [None, 5.0]):
        f = field(spark, [[[1.0, other[0]]], [[2.0, other[1]]]], step=0.1)
        places = f.select("lat_idx", "lon_idx", "latitude", "longitude").distinct()
        got = {(r["cell_id"], r["t"]): r["sla"] for r in smoothing.gauss_smooth(f, places, 10.0, 2, digits=None).collect()}
        w = math.exp(-((6371.0088 * math.radians(0.1)) ** 2) / (2 * sigma(10.0) ** 2))
        assert got[0, 1] == pytest.approx((2 + w * (other[1] or 0)) / (1 + w))
        assert (1, 0) not in got  # a cell with gaps has no result


def test_cells_without_neighbours_keep_their_series(spark):
    f = field(spark, [[[1.0, 9.0]], [[2.0, 9.0]]], step=40.0)
    places = f.select("lat_idx", "lon_idx", "latitude", "longitude").distinct()
    assert {r["sla"] for r in smoothing.gauss_smooth(f, places, 10.0, 2).where("cell_id = 0").collect()} == {1.0, 2.0}


def test_smoothing_goes_round_the_globe(spark):
    f = field(spark, [[[float(j) for j in range(36)]]], lon0=-180.0, step=10.0)
    places = f.select("lat_idx", "lon_idx", "latitude", "longitude").distinct()
    got = {r["cell_id"]: r["sla"] for r in smoothing.gauss_smooth(f, places, 600.0, 36, wrap=True, digits=None).collect()}
    assert got[0] > 2  # column 35 is next to column 0


def test_rolling_mean(spark):
    f = field(spark, [[[float(t)]] if t != 4 else [[None]] for t in range(10)])
    got = [r["sla"] for r in smoothing.rolling_mean(f, 3).orderBy("t").collect()]
    assert got == [0.5, 1, 2, 2.5, None, 5.5, 6, 7, 8, 8.5]


def test_label_smoothing_takes_the_majority(spark):
    places = cells(spark, [(i, j) for i in range(3) for j in range(3)])
    labels = spark.createDataFrame([(k, 1 if k == 4 else 2) for k in range(9)], "cell_id long, cluster_id int")
    assert {r["cluster_id"] for r in smoothing.smooth_labels(labels, places, places, 200.0, 3).collect()} == {2}
    lone = cells(spark, [(0, 0), (0, 40)])
    kept = smoothing.smooth_labels(labels.limit(2), lone, lone, 200.0, 80)
    assert kept.count() == 2


def test_masks(spark):
    f = field(spark, [[[1.0, None, None]], [[2.0, 3.0, None]]])
    assert [r["cell_id"] for r in masks.valid_cells(f).collect()] == [0]
    assert {r["cell_id"] for r in masks.any_valid_cells(f).collect()} == {0, 1}
    assert [(r["t"], r["n_missing"]) for r in masks.gaps_by_time(f).orderBy("t").collect()] == [(0, 2), (1, 1)]
    assert masks.to_series(f).first()["x"] == [1.0, 2.0]
    filled = f.withColumn("sla", F.lit(7.0))
    assert masks.restore_gaps(filled, f).where("sla is null").count() == 3
    assert masks.restore_gaps(filled, f, whole_cell=True).where("sla is null").count() == 4


def test_neighbours_on_a_grid(spark):
    c = cells(spark, [(0, 0), (0, 1), (1, 0), (1, 1), (0, 4)])
    assert edges_of(stencil.neighbours(c)) == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)}
    assert edges_of(stencil.neighbours(c, stencil.FOUR)) == {(0, 1), (0, 2), (1, 3), (2, 3)}
    assert edges_of(stencil.neighbours(c, n_lon=5)) - edges_of(stencil.neighbours(c)) == {(0, 4), (2, 4)}
    # columns 0 and 3 hold the outermost cells of a grid with empty columns beyond
    seam = cells(spark, [(0, 1), (0, 8), (1, 8)])
    assert edges_of(stencil.neighbours(seam, n_lon=12, seam=True)) == {(0, 1), (0, 2), (1, 2)}
    assert stencil.neighbours(c.limit(0)).count() == 0


def test_components_and_their_graph(spark):
    labels = spark.createDataFrame([(k, c) for k, c in enumerate([0, 0, 1, 0, 1])], "cell_id long, cluster_id int")
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (2, 4), (3, 4)], "src long, dst long")
    assert edges_of(graph.same_cluster_edges(links, labels).select("src", "dst")) == {(0, 1), (2, 4)}
    comps = graph.components(labels, links)
    assert {r["cell_id"]: r["comp_id"] for r in comps.collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 2}
    assert edges_of(graph.component_adjacency(comps, links)) == {(0, 2), (2, 3)}
    assert graph.smallest_component(comps).first()["comp_id"] == 3
    assert [r["cluster_id"] for r in graph.empty_clusters(labels, 4).orderBy("cluster_id").collect()] == [2, 3]
    assert graph.components(labels, links.limit(0)).where("comp_id <> cell_id").count() == 0
    path = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    one = spark.range(201).select(F.col("id").alias("cell_id"), F.lit(0).alias("cluster_id"))
    assert graph.components(one, path).where("comp_id <> 0").count() == 0


def test_component_centres_across_the_date_line(spark):
    comps = spark.createDataFrame([(k, 0, 0) for k in range(3)] + [(3, 1, 3)], "cell_id long, cluster_id int, comp_id long")
    at = spark.createDataFrame([(0, 1.0, 175.0), (1, 2.0, 179.0), (2, 3.0, -175.0), (3, 0.0, 5.0)], "cell_id long, latitude double, longitude double")
    got = {r["comp_id"]: (r["latitude"], r["longitude"]) for r in graph.component_centres(comps, at).collect()}
    assert got == {0: (2.0, 179.0), 3: (0.0, 5.0)}


def test_regridding(spark):
    f = field(spark, [[[float(10 * i + j) for j in range(9)] for i in range(9)]], lat0=-8.0, lon0=-8.0, step=2.0)
    with pytest.raises(ValueError):
        regrid.bilinear(f, 1, -8.0, -8.0, 2.0)
    with pytest.raises(ValueError):
        regrid.check_step(0.8, 0.5)
    assert regrid.bilinear(f, 2, -8.0, -8.0, 2.0) is f
    got = {(r["latitude"], r["longitude"]): r["sla"] for r in regrid.bilinear(f, 5, -8.0, -8.0, 2.0).collect()}
    assert got == {(a, b): pytest.approx(10 * (a + 8) / 2 + (b + 8) / 2) for a in (-5.0, 0.0, 5.0) for b in (-5.0, 0.0, 5.0)}
    gap = f.withColumn("sla", F.when((F.col("lat_idx") == 1) & (F.col("lon_idx") == 1), None).otherwise(F.col("sla")))
    assert {(r["latitude"], r["longitude"]) for r in regrid.bilinear(gap, 5, -8.0, -8.0, 2.0).where("sla is null").collect()} == {(-5.0, -5.0)}
    labels = spark.createDataFrame([(0, 0, 5), (0, 1, 6)], "lat_idx int, lon_idx int, cluster_id int")
    fine = spark.createDataFrame([(1, 0.4, 0.9), (2, 0.4, 1.2), (3, 9.0, 9.0)], "cell_id long, latitude double, longitude double")
    assert {r["cell_id"]: r["cluster_id"] for r in regrid.nearest_labels(labels, fine, 0.0, 0.0, 2.0).collect()} == {1: 5, 2: 6}


def test_bilinear_onto_uneven_axes_equals_a_sum_over_corners(spark):
    rng = np.random.default_rng(3)
    y, x = np.array([40.0, 31.5, 10.0, -2.0, -30.0]), np.array([-20.0, -19.0, -7.0, 0.0, 30.0, 31.0])
    values = rng.normal(size=(2, 5, 6))
    values[0, 1, 2] = np.nan
    rows = [(i, j, t, float(y[i]), float(x[j]), None if np.isnan(values[t, i, j]) else float(values[t, i, j])) for t in range(2) for i in range(5) for j in range(6) if (t, i, j) != (1, 4, 0)]
    f = spark.createDataFrame(rows, "lat_idx int, lon_idx int, t int, latitude double, longitude double, sla double")
    values[1, 4, 0] = np.nan
    lats, lons = [35.0, -2.0, 41.0, float("nan"), -30.0, 0.0, 39.0], [30.5, -20.0, -8.0, 31.0, -21.0]

    def around(axis, v):
        order = np.argsort(axis)
        for a, b in zip(order[:-1], order[1:], strict=True):
            if axis[a] == v:
                return [(a, 1.0)]
            if axis[a] < v < axis[b]:
                w = (v - axis[a]) / (axis[b] - axis[a])
                return [(a, 1 - w), (b, w)]
        return [(order[-1], 1.0)] if axis[order[-1]] == v else []

    want = {}
    for t in range(2):
        for a, lat in enumerate(lats):
            for b, lon in enumerate(lons):
                corners = [(values[t, i, j], u * w) for i, u in around(y, lat) for j, w in around(x, lon)]
                if corners:
                    found = sum(v * w for v, w in corners)
                    want[t, a, b] = None if np.isnan(found) else pytest.approx(found, abs=1e-12)
    got = regrid.bilinear_onto(f, lats, lons).collect()
    # a target whose only corner has no row at a time has none either
    assert {(r.t, r.lat_idx, r.lon_idx): r.sla for r in got} == {k: v for k, v in want.items() if k != (1, 4, 1)}
    assert all(r.cell_id == r.lat_idx * 5 + r.lon_idx and r.latitude == lats[r.lat_idx] and r.longitude == lons[r.lon_idx] for r in got)
    assert regrid.bilinear_onto(f.limit(0), lats, lons).count() == 0
    assert regrid.bilinear_onto(f, [], lons).count() == 0
    with pytest.raises(ValueError, match="name each other"):
        regrid.bilinear_onto(f.withColumn("latitude", F.lit(1.0)), lats, lons)


def test_gradients_equal_numpy(spark):
    v = np.random.default_rng(1).normal(size=(5, 4, 6))
    f = field(spark, v.tolist())
    got = gradients.gradients(f).toPandas().set_index(["t", "lat_idx", "lon_idx"]).sort_index()
    for name, want in zip(("g_time", "g_lat", "g_lon"), np.gradient(v), strict=True):
        assert got[name].to_numpy() == pytest.approx(want.ravel())
    magnitude = gradients.mean_magnitude(f).toPandas().sort_values("cell_id")["magnitude"].to_numpy()
    assert magnitude == pytest.approx(np.sqrt(sum(g**2 for g in np.gradient(v))).mean(axis=0).ravel())


def test_pairs(spark):
    x = np.random.default_rng(2).normal(size=(30, 5))
    series = spark.createDataFrame([(k, 0.0, 0.0, v) for k, v in enumerate(x.tolist())], "cell_id long, latitude double, longitude double, x array<double>")
    got = {(r["i"], r["j"]): r["d"] for r in pairs.all_pairs(series, "euclidean", block=7).collect()}
    assert len(got) == 435
    assert all(d == pytest.approx(np.linalg.norm(x[i] - x[j])) and i < j for (i, j), d in got.items())


def test_label_round_trip(spark, tmp_path):
    labels = spark.createDataFrame([(0, 7), (1, 7), (2, 3), (3, 3)], "cell_id long, cluster_id int")
    sinks.write_labels(labels, str(tmp_path / "labels"))
    back = {r["cell_id"]: r["cluster_id"] for r in spark.read.parquet(str(tmp_path / "labels")).collect()}
    assert back == {0: 1, 1: 1, 2: 0, 3: 0}


def test_files(spark, tmp_path):
    (tmp_path / "index.txt").write_text("1992.9 1\n1993.0 2.0\n1993.5 4\nbad line\n")
    rows = fields.read_climate_index(spark, str(tmp_path / "index.txt")).orderBy("ts").collect()
    assert [(r["value"], r["anomaly"]) for r in rows] == [(2.0, -1.0), (4.0, 1.0)]
    (tmp_path / "gauge.csv").write_text("1993.0;7000;0;0\n1993.1;-99999;0;0\nxx;1;0;0\n")
    gauge = fields.read_tide_gauge(spark, str(tmp_path / "gauge.csv"), "a").orderBy("decimal_year").collect()
    assert [(r["decimal_year"], r["value"]) for r in gauge] == [(1993.0, 7000.0), (1993.1, None)]
    with pytest.raises(Exception, match="(?i)path"):
        fields.read_tide_gauge(spark, str(tmp_path / "none.csv"), "a").count()
    f = field(spark, [[[1.0, float("nan")]]])
    sinks.write_field(f, str(tmp_path / "field"))
    assert fields.read_fields(spark, str(tmp_path / "field")).where("sla is null").count() == 1
    made = []
    for _ in range(2):
        sinks.cached(spark, str(tmp_path / "kept"), lambda: made.append(1) or f)
    assert made == [1]


def test_cells_travel_a_bounded_number_of_times(spark):
    """As often as there are blocks, whose number doesn't follow that of the cells up to the bound; pairs are whole over several batches and tiles."""
    import re

    n = 3000
    rows = [(k, float(k % 90), float(k % 180), [float(k), 1.0]) for k in range(n)]
    series = spark.createDataFrame(rows, "cell_id long, latitude double, longitude double, x array<double>")
    found = pairs.all_pairs(series, "euclidean")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert {int(m) for m in re.findall(r"sequence\(0, (\d+)", plan)} == {pairs.BLOCKS - 1}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = found.selectExpr("count(*) as n", "count(distinct i, j) as k", "sum(d) as s", "min(j - i) as low", "max(abs(d - (j - i))) as off").first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["n"] == got["k"] == n * (n - 1) // 2
    assert got["low"] == 1 and got["off"] < 1e-6


@pytest.mark.parametrize("keys", [1 << 24, 2000])
def test_rounded_pairs_are_whole_and_leave_in_the_order_of_distances(spark, monkeypatch, keys):
    """Also in several ranges of distances, with distances too long for a key, and with none."""
    monkeypatch.setattr(pairs, "KEYS", keys)
    monkeypatch.setattr(pairs, "STRIP", 500)
    x = np.random.default_rng(2).normal(size=(150, 3))
    x[7], x[8] = x[6], 1e13
    series = spark.createDataFrame([(1000 - k, float(k % 90), float(k), v) for k, v in enumerate(x.tolist())], "cell_id long, latitude double, longitude double, x array<double>")
    plain = {(r["i"], r["j"]): r["d"] for r in pairs.all_pairs(series, "euclidean", block=60).collect()}
    found = pairs.all_pairs(series, "euclidean", block=60, digits=2)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len({r[:2] for r in got}) == 150 * 149 // 2
    assert all(i < j and d == pytest.approx(plain[i, j], abs=0.00501, rel=1e-12) for i, j, d in got)
    for part in found.rdd.glom().collect():  # one pair of blocks each
        d = [r["d"] for r in part if r["d"] < 1e9]
        assert d and d == sorted(d)
    flat = spark.createDataFrame([(k, 0.0, 0.0, [1.0, 1.0]) for k in range(5)], series.schema)
    assert pairs.all_pairs(flat, "spatiotemporal", digits=6).count() == 0


def test_rounding_is_that_of_sql():
    import duckdb

    d = np.array([0.0, 0.1234565, 2.5, 0.0000005, 0.00000049999999999999994, 1.0000015, 12.3456785, 1e300, -0.0000015])
    want = duckdb.sql(f"SELECT round(x, 6) FROM (SELECT unnest({d.tolist()}::DOUBLE[]) AS x)").fetchall()
    with np.errstate(over="ignore"):
        assert (pairs.rounded(d, 6) / 1e6)[:7].tolist() == [w[0] for w in want][:7]
        assert pairs.rounded(d, 6)[8] / 1e6 == want[8][0]


def test_sorted_pairs_take_less_room(spark, tmp_path):
    """A few bytes a pair, as Parquet, instead of the eight of a double."""
    import os

    x = np.random.default_rng(4).normal(size=(2000, 8))
    series = spark.createDataFrame([(k, 0.0, 0.0, v) for k, v in enumerate(x.tolist())], "cell_id long, latitude double, longitude double, x array<double>")
    pairs.all_pairs(series, "euclidean", digits=4).write.parquet(str(tmp_path / "pairs"))
    assert sum(f.stat().st_size for f in os.scandir(tmp_path / "pairs") if f.name.endswith(".parquet")) < 6 * 2000 * 1999 / 2
