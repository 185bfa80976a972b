"""The filter by rows against the weighted sum over every place in reach."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import bands, smoothing
from fieldloom.operators.masks import CELL
from fieldloom.operators.stencil import in_reach, radius_stencil


def joined(field, grid, half_width, n_lon, wrap):
    """Each cell joined with every place in its reach, at all times."""
    cells = field.groupBy(*CELL).agg((F.count("sla") == F.count(F.lit(1))).alias("whole")).where("whole").drop("whole")
    reach = in_reach(cells, radius_stencil(grid, half_width, n_lon, wrap), grid, n_lon, wrap)
    values = field.where("sla is not null").select(F.col("lat_idx").alias("to_lat"), F.col("lon_idx").alias("to_lon"), "t", "sla")
    return reach.join(values, ["to_lat", "to_lon"]).groupBy("cell_id", "t").agg(F.sum(F.col("w") * F.col("sla")).alias("sla"))


def field_of(spark, n_lat, n_lon, step, lat0, times, gaps, seed=0):
    """A whole number of cells have gaps, some have no row at all; values differ much in size."""
    rng = random.Random(seed)
    rows = []
    for i in range(n_lat):
        for j in range(n_lon):
            if rng.random() < gaps / 4:
                continue
            holes = rng.random() < gaps
            size = 10.0 ** rng.randint(-3, 3)
            rows += [(i * n_lon + j, i, j, t, lat0 + step * i, -180.0 + step * j, None if holes and rng.random() < 0.5 else size * rng.gauss(0, 1)) for t in range(times)]
    return spark.createDataFrame(rows, "cell_id long, lat_idx int, lon_idx int, t int, latitude double, longitude double, sla double")


def places_of(spark, n_lat, n_lon, step, lat0, without=()):
    return spark.createDataFrame([(i, j, lat0 + step * i, -180.0 + step * j) for i in range(n_lat) for j in range(n_lon) if (i, j) not in without], "lat_idx int, lon_idx int, latitude double, longitude double")


@pytest.mark.parametrize(("n_lat", "n_lon", "step", "lat0", "half_width", "wrap", "gaps"), [
    (12, 36, 10.0, -55.0, 900.0, True, 0.2),
    (12, 36, 10.0, -55.0, 900.0, False, 0.2),
    (30, 17, 0.5, 60.0, 60.0, False, 0.0),
    (9, 20, 18.0, -72.0, 2500.0, True, 0.3),
    (1, 30, 1.0, 0.0, 200.0, False, 0.3),
    (40, 2, 1.0, -20.0, 200.0, False, 0.3),
])
def test_rows_equal_the_sum_over_places(spark, n_lat, n_lon, step, lat0, half_width, wrap, gaps):
    field = field_of(spark, n_lat, n_lon, step, lat0, 5, gaps)
    grid = places_of(spark, n_lat, n_lon, step, lat0)
    got = {(r["cell_id"], r["t"]): r["sla"] for r in smoothing.gauss_smooth(field, grid, half_width, n_lon, wrap, digits=None).collect()}
    want = {(r["cell_id"], r["t"]): r["sla"] for r in joined(field, grid, half_width, n_lon, wrap).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert max(abs(got[k] - v) for k, v in want.items()) < 1e-9


def test_places_that_the_grid_lacks_have_no_weight(spark):
    without = {(2, 3), (2, 4), (5, 0), (0, 0)}
    field = field_of(spark, 8, 12, 2.0, 10.0, 3, 0.1)
    grid = places_of(spark, 8, 12, 2.0, 10.0, without)
    got = {(r["cell_id"], r["t"]): r["sla"] for r in smoothing.gauss_smooth(field, grid, 200.0, 12, digits=None).collect()}
    want = {(r["cell_id"], r["t"]): r["sla"] for r in joined(field, grid, 200.0, 12, False).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - v) for k, v in want.items()) < 1e-9


def test_bands_cover_every_row_and_move_each_about_twice():
    weights = bands.RowWeights({i: -89.875 + 0.25 * i for i in range(720)}, 0.25, 1440, 500.0, True)
    needed, own = bands.bands_of(weights)
    assert sorted(r for rows in own.values() for r in rows) == list(range(720))
    assert all((o, b) in set(needed) for b, rows in own.items() for r in rows[:: max(1, len(rows) // 3)] for o in weights.near(r))
    assert len(needed) < 2.1 * 720


def test_the_plan_moves_values_by_band_only(spark):
    """One exchange of values for the sums; none of pairs of places."""
    field = field_of(spark, 6, 12, 2.0, 10.0, 3, 0.0)
    sums = bands.banded_sums(field, places_of(spark, 6, 12, 2.0, 10.0), 200.0, 12, False)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_no_values_and_no_grid(spark):
    field = field_of(spark, 2, 2, 1.0, 0.0, 1, 0.0)
    grid = places_of(spark, 2, 2, 1.0, 0.0)
    assert bands.banded_sums(field.limit(0), grid, 100.0, 2, False).count() == 0
    assert bands.banded_sums(field, grid.limit(0), 100.0, 2, False).count() == 0
    with pytest.raises(ValueError, match="a grid of more"):
        bands.banded_sums(field, grid, 100.0, 1 << 30, False)


def test_transform_of_a_row_is_that_of_its_weights():
    weights = bands.RowWeights({0: 0.0, 1: 1.0}, 1.0, 30, 200.0, False)
    line = np.fft.irfft(weights.transform(0, 1), weights.length)
    km = 6371.0088 * 2 * math.asin(math.sqrt(math.sin(math.radians(0.5)) ** 2 + math.cos(math.radians(1)) * math.sin(math.radians(1)) ** 2))
    assert line[2] == pytest.approx(math.exp(-(km**2) / (2 * (200 / 1.178) ** 2)))
    assert line[2] == pytest.approx(line[-2])


def test_rows_beyond_a_pole_reach_nothing(spark):
    """As in SQL, where the box is narrower than nothing there; cells left of it keep their own places only."""
    n_lat, n_lon = 30, 6
    grid = places_of(spark, n_lat, n_lon, 2.0, 60.0)
    cells = grid.select((F.col("lat_idx") * n_lon + F.col("lon_idx")).cast("long").alias("cell_id"), "lat_idx", "lon_idx", (F.col("lon_idx") % 2).alias("cluster_id"))
    reach = in_reach(cells, radius_stencil(grid, 200.0, n_lon, False), grid, n_lon, False)
    inside = [i for i in range(n_lat) if math.cos(math.radians(60.0 + 2 * i)) >= 0]
    assert 0 < len(inside) < n_lat
    assert {r["cell_id"] // n_lon for r in reach.select("cell_id").distinct().collect()} == set(inside)
    smooth = smoothing.smooth_labels(cells, cells, grid, 200.0, n_lon)
    assert smooth.count() == len(inside) * n_lon
    # all rows beyond it: no sums, whatever the values
    far = places_of(spark, 4, n_lon, 2.0, 100.0)
    values = far.select("lat_idx", "lon_idx", F.lit(0).alias("t"), F.lit(1.0).alias("sla"))
    assert bands.banded_sums(values, far, 200.0, n_lon, False).count() == 0
