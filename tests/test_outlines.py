"""Outlines against rings walked side by side."""

import numpy as np
import pytest

from fieldloom.operators import outlines


def frame(spark, labels):
    n = labels.shape[1]
    rows = [(i * n + j, i, j, None if labels[i, j] < 0 else int(labels[i, j])) for i in range(labels.shape[0]) for j in range(n)]
    return spark.createDataFrame(rows, "cell_id long, lat_idx int, lon_idx int, cluster_id int").repartition(3)


def walked(labels, n_lon):
    """Set of rings, each a tuple of (side, corner), from the least side on."""
    n, m = labels.shape
    at = lambda i, j: labels[i, j % m if n_lon else j] if 0 <= i < n and (n_lon or 0 <= j < m) else -1
    wrap = lambda p: (p[0], p[1] % n_lon) if n_lon else p
    found = {}
    for i in range(n):
        for j in range(m):
            square = [(i, j), (i, j + 1), (i + 1, j + 1), (i + 1, j)]
            for w, (a, b) in enumerate([(i - 1, j), (i, j + 1), (i + 1, j), (i, j - 1)]):
                if labels[i, j] >= 0 and at(a, b) != labels[i, j]:
                    found[(i * m + j) * 4 + w] = (int(labels[i, j]), w, wrap(square[w]), wrap(square[(w + 1) % 4]))
    rings, left = set(), set(found)
    while left:
        ring = [min(left)]
        while True:
            label, way, _, end = found[ring[-1]]
            nexts = {found[s][1]: s for s in found if found[s][0] == label and found[s][2] == end}
            s = next(nexts[(way + t) % 4] for t in (1, 0, 3) if (way + t) % 4 in nexts)
            if s == ring[0]:
                break
            ring.append(s)
        left -= set(ring)
        rings.add(tuple((s, *found[s][2]) for s in ring))
    return rings


@pytest.mark.parametrize(("seed", "wrap"), [(0, False), (1, True)])
def test_rings_equal_a_walk(spark, seed, wrap):
    rng = np.random.default_rng(seed)
    labels = rng.integers(-1, 2, (5, 6))
    labels[3] = 1  # goes round the globe
    labels[:2, 0] = labels[:2, 5] = 0  # on both sides of the seam
    n_lon = 6 if wrap else None
    outline = outlines.outlines(frame(spark, labels), n_lon)
    want = walked(labels, n_lon)
    got = {}
    for r in outlines.corners(outline).orderBy("ring_id", "pos").collect():
        got.setdefault(r["ring_id"], []).append((r["pos"], r["i"], r["j"]))
    assert {k: [(p, i, j) for p, (_, i, j) in enumerate(w)] for w in want for k in [w[0][0]]} == got
    rows = outlines.rings(outline, n_lon).collect()
    assert {r["ring_id"]: r["n_sides"] for r in rows} == {w[0][0]: len(w) for w in want}
    for c in (0, 1):
        assert sum(r["area"] for r in rows if r["cluster_id"] == c) == int((labels == c).sum())
    assert any(r["kind"] == "round" for r in rows) == wrap


def test_hole_and_no_cells(spark):
    labels = np.ones((5, 5), int)
    labels[1, 1] = labels[2, 2] = 7  # meet in a corner: two outlines, and one hole around both or two, as the turns say
    labels[4, 4] = -1
    rows = outlines.rings(outlines.outlines(frame(spark, labels))).collect()
    assert sorted((r["cluster_id"], r["kind"], r["area"], r["n_sides"]) for r in rows) == [(1, "hole", -2, 8), (1, "outer", 24, 20), (7, "outer", 1, 4), (7, "outer", 1, 4)]
    none = outlines.outlines(frame(spark, labels).limit(0))
    assert outlines.rings(none).count() == outlines.corners(none).count() == 0


def test_rounds_of_a_long_ring(spark, monkeypatch):
    """A comb of 30 teeth has one ring of 1,982 sides; rounds follow the logarithm of its length."""
    from fieldloom.operators import graph

    calls = []
    for module in (outlines, graph):
        monkeypatch.setattr(module, "stored", lambda frame, stored=module.stored: (calls.append(1), stored(frame))[1])
    labels = np.full((32, 60), -1)
    labels[:, ::2] = labels[0] = 0
    rows = outlines.rings(outlines.outlines(frame(spark, labels))).collect()
    assert [(r["n_sides"], r["area"], r["kind"]) for r in rows] == [(1982, 990, "outer")]
    assert len(calls) <= 2 + 12
