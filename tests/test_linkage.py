"""Linkage from series, by rounds over blocks, against one kernel over the whole matrix."""

import numpy as np
import pytest

from fieldloom.functions.distances import metric
from fieldloom.operators import agglomeration, linkage
from fieldloom.operators.pairs import _cells


def cells_of(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(7 * k, float(rng.uniform(-60, 60)), float(rng.uniform(-180, 180)), rng.normal(size=6).tolist()) for k in range(n)]
    rows[5] = (*rows[5][:3], [1.0] * 6)  # constant: no correlation with any
    rows[9], rows[20] = (*rows[9][:3], rows[2][3]), (*rows[20][:3], rows[2][3])  # equal series
    return spark.createDataFrame(rows, "cell_id long, latitude double, longitude double, x array<double>").repartition(3)


@pytest.mark.parametrize("tile", [40, 1 << 20])
@pytest.mark.parametrize("ward", [False, True])
def test_rounds_equal_one_kernel(spark, monkeypatch, ward, tile):
    monkeypatch.setattr(linkage, "TILE", tile)
    monkeypatch.setattr(linkage, "BLOCK", 17)  # of several blocks
    series = cells_of(spark, 60)
    rows = series.orderBy("cell_id").toPandas()
    name = "squared_euclidean" if ward else "spatiotemporal"
    d = metric(name).block(_cells(rows), _cells(rows))
    want = sorted(agglomeration.average_linkage(rows["cell_id"].to_numpy(), np.ones(60), d / 2 if ward else d, ward))
    for kernel in (8, 60):
        found = linkage.ward_merges(series, kernel) if ward else linkage.upgma_merges(series, name, kernel)
        got = sorted(tuple(r) for r in found.select("d", "keep", "gone").collect())
        assert len(got) == len(want) == (59 if ward else 58)
        assert [x[0] for x in got] == pytest.approx([x[0] for x in want], rel=1e-9, abs=1e-12)
        ids = rows["cell_id"].tolist()
        for k in (2, 3, 10, 30):
            assert agglomeration.cut_tree(ids, got, [k]) == agglomeration.cut_tree(ids, want, [k])


def test_no_table_has_a_row_for_two_cells(spark, monkeypatch):
    """What rounds hand on grows with the cells."""
    seen, stored = [], linkage.stored
    monkeypatch.setattr(linkage, "stored", lambda frame: (out := stored(frame), seen.append(out.count()))[0])
    linkage.upgma_merges(cells_of(spark, 60), "euclidean", 10)
    assert max(seen) <= 60


def test_clusters_look_again_only_where_their_nearest_is_lost(spark, monkeypatch):
    """Cells in pairs far apart, one of which waits for a third round: after the first round only merged ones look, and those whose nearest has merged."""
    asked, searched = [], linkage._searched
    monkeypatch.setattr(linkage, "_searched", lambda rows, make, asking, blocks: (asked.append(asking), searched(rows, make, asking, blocks))[1])
    at = [0.0, 1.0, 10.0, 12.0, 100.0, 101.0, 1000.0, 2000.0, 5000.0]
    series = spark.createDataFrame([(k, 0.0, 0.0, [x, 0.0]) for k, x in enumerate(at)], "cell_id long, latitude double, longitude double, x array<double>")
    merges = sorted(tuple(r) for r in linkage.upgma_merges(series, "euclidean", 1).collect())
    assert [m[1:] for m in merges[:4]] == [(0, 1), (4, 5), (2, 3), (0, 2)] and len(merges) == 8
    assert asked[0] == 9 and all(n < 9 for n in asked[1:3])


def test_places_shared_by_many_cells_give_the_same_distances():
    rng = np.random.default_rng(1)
    cells = (np.repeat(rng.uniform(-500, 500, 6), 20), np.tile(rng.uniform(-180, 180, 4), 30), rng.normal(size=(120, 5)))
    m = metric("spatiotemporal")
    assert m.table(m.ready(cells), m.ready(cells)) is not None
    assert m.tiles(cells, cells)(slice(7, 90), slice(0, 120)) == pytest.approx(m.block(cells, cells)[7:90], abs=1e-12)
    x = rng.normal(size=(40, 7))
    x[3, 2] = np.nan
    assert linkage._added(x, np.array([1, 4, 5, 30])) == pytest.approx(np.add.reduceat(x, [0, 1, 5, 10], axis=0), nan_ok=True)


def test_ward_looks_again_only_where_the_nearest_is_lost(spark, monkeypatch):
    asked, searched = [], linkage._searched
    monkeypatch.setattr(linkage, "_searched", lambda rows, make, asking, blocks: (asked.append((asking, rows.count())), searched(rows, make, asking, blocks))[1])
    at = [0.0, 1.0, 100.0, 104.0, 109.5, 1000.0, 2000.0]
    series = spark.createDataFrame([(k, 0.0, 0.0, [x, 0.0]) for k, x in enumerate(at)], "cell_id long, latitude double, longitude double, x array<double>")
    merges = sorted(tuple(r) for r in linkage.ward_merges(series, 3).collect())
    assert merges[0] == (0.5, 0, 1) and merges[1] == (8.0, 2, 3) and merges[2] == (pytest.approx(2 / 3 * 7.5**2), 2, 4) and len(merges) == 6
    assert asked[0] == (7, 7) and asked[1][0] < asked[1][1]
