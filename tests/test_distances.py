import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geo
from fieldloom.functions.distances import METRICS, metric, residual

CELL = "latitude double, longitude double, x array<double>"


def column(spark, name, a, b):
    frame = spark.createDataFrame([(a, b)], f"a struct<{','.join(p.replace(' ', ':', 1) for p in CELL.split(', '))}>, b struct<{','.join(p.replace(' ', ':', 1) for p in CELL.split(', '))}>")
    return frame.select(metric(name).column(F.col("a"), F.col("b")).alias("d")).first()["d"]


def block(name, a, b):
    cells = lambda c: (np.array([c[0]]), np.array([c[1]]), np.array([c[2]], dtype=float))
    return float(METRICS[name].block(cells(a), cells(b))[0, 0])


@pytest.mark.parametrize("form", [column, block])
def test_euclidean(spark, form):
    at = (lambda n, a, b: column(spark, n, a, b)) if form is column else block
    a, b = (0.0, 0.0, [0.0, 0.0]), (10.0, 10.0, [3.0, 4.0])
    assert at("euclidean", a, b) == pytest.approx(5)
    assert at("squared_euclidean", a, b) == pytest.approx(25)
    assert at("abs_sum", a, b) == pytest.approx(7)


@pytest.mark.parametrize("form", [column, block])
def test_spatiotemporal(spark, form):
    at = (lambda n, a, b: column(spark, n, a, b)) if form is column else block
    up, down = [1.0, 2.0, 3.0, 4.0], [4.0, 3.0, 2.0, 1.0]
    assert at("spatiotemporal", (10.0, 20.0, up), (10.0, 20.0, up)) == pytest.approx(0, abs=1e-12)
    assert at("spatiotemporal", (10.0, 20.0, up), (10.0, 20.0, down)) == pytest.approx(2)
    near, far = at("spatiotemporal", (0.0, 0.0, up), (0.0, 1.0, up)), at("spatiotemporal", (0.0, 0.0, up), (0.0, 30.0, up))
    assert 0 < near < far
    assert -math.log(1 - near) * (-3000 / math.log(0.5)) == pytest.approx(111.19, abs=0.01)


def test_constant_series_have_no_correlation(spark):
    constant = [2.0, 2.0, 2.0]
    assert column(spark, "spatiotemporal", (0.0, 0.0, constant), (0.0, 0.0, [1.0, 2.0, 3.0])) is None
    assert math.isnan(block("spatiotemporal", (0.0, 0.0, constant), (0.0, 0.0, [1.0, 2.0, 3.0])))


@pytest.mark.parametrize(("x", "mean", "want"), [([5.0, 0.0, 0.0], [0.0, 0.0, 0.0], 0), ([0.0, 3.0, 4.0], [0.0, 0.0, 0.0], 25), ([1.0, 1.0, 0.0], [0.0, 0.0, 0.0], 1)])
def test_residual(spark, x, mean, want):
    frame = spark.createDataFrame([(x, mean, [[1.0, 0.0, 0.0]])], "x array<double>, mean array<double>, basis array<array<double>>")
    assert frame.select(residual(F.col("x"), F.col("mean"), F.col("basis")).alias("d")).first()["d"] == pytest.approx(want)


def test_unknown_metric():
    with pytest.raises(ValueError):
        metric("manhattan")


def test_weights_and_coordinates(spark):
    frame = spark.createDataFrame([(0.0, 1.0), (60.0, 1.0)], "latitude double, sla double")
    got = [r["w"] for r in frame.select(geo.cos_weighted(F.col("sla"), F.col("latitude")).alias("w")).collect()]
    assert got == pytest.approx([1, 0.5])
    corners = spark.createDataFrame([(-89.875, -179.875), (89.875, 179.875), (0.125, 0.125)], "lat double, lon double")
    at = lambda c, o, t: geo.coord_to_index(F.col(c), o, 0.25, t)
    for truncate in (False, True):
        assert [tuple(r) for r in corners.select(at("lat", -89.875, truncate), at("lon", -179.875, truncate)).collect()] == [(0, 0), (719, 1439), (360, 720)]
    back = spark.createDataFrame([(0, 0), (1, 2)], "i int, j int")
    assert [tuple(r) for r in back.select(geo.index_to_coord(F.col("i"), -10.0, 2.0), geo.index_to_coord(F.col("j"), 20.0, 2.0)).collect()] == [(-10.0, 20.0), (-8.0, 24.0)]


def test_longitudes_and_years(spark):
    frame = spark.createDataFrame([(190.0,), (-190.0,), (180.0,), (0.0,)], "lon double")
    assert [r[0] for r in frame.select(geo.normalise_longitude(F.col("lon"))).collect()] == [-170.0, 170.0, -180.0, 0.0]
    ts = spark.createDataFrame([(1993.0,), (1993.5,)], "y double").select(geo.decimal_year_to_timestamp(F.col("y")).alias("t")).collect()
    assert [str(r["t"]) for r in ts] == ["1993-01-01 00:00:00", "1993-07-02 15:00:00"]
