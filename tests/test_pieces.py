"""Linkage by pieces against the same in one task."""

import random

import pandas as pd
import pytest

from fieldloom.operators import agglomeration, pieces


def graph(seed, rows=8, columns=9, values=None, drop=0.1):
    """A grid with 8 neighbours, some edges dropped. values: so many different distances (ties), None: all differ."""
    rng = random.Random(seed)
    edges = {}
    for i in range(rows):
        for j in range(columns):
            for di, dj in ((0, 1), (1, 0), (1, 1), (1, -1)):
                a, b = i * columns + j, (i + di) * columns + j + dj
                if i + di < rows and 0 <= j + dj < columns and rng.random() >= drop:
                    edges[a, b] = float(rng.randint(1, values)) if values else rng.random()
    return list(range(rows * columns)), edges


@pytest.mark.parametrize("values", [None, 3, 1])
def test_merging_of_a_graph_equals_the_dictionary_version(values):
    for seed in range(20):
        cells, edges = graph(seed, 5, 6, values)
        state = pieces.Linkage(dict.fromkeys(cells, 1), [(a, b, d) for (a, b), d in edges.items()])
        assert [s[:3] for s in state.merged()] == agglomeration.constrained_merges(dict.fromkeys(cells, 1), edges)


@pytest.mark.parametrize(("seed", "values", "kernel"), [(1, None, 20), (2, 3, 15)])
def test_pieces_equal_one_task(spark, seed, values, kernel):
    """The same merges in the same order, to the last bit."""
    cells, edges = graph(seed, 5, 6, values)
    frame = spark.createDataFrame([(i,) for i in cells], "cell_id long").repartition(3)
    distances = spark.createDataFrame([((b, a, d) if a % 2 else (a, b, d)) for (a, b), d in edges.items()], "src long, dst long, d double").repartition(3)
    found = pieces.merges(distances, frame, kernel, 20)
    assert [(r["d"], r["a"], r["b"]) for r in found.orderBy("key_d", "key_a", "key_b", "key_n").collect()] == agglomeration.constrained_merges(dict.fromkeys(cells, 1), edges)


def test_a_task_takes_many_pieces():
    """Pairs of pieces that share a group stay apart: steps of one don't touch the edges of another."""
    edges = pd.DataFrame([(1, 2, 1, 5, 1.0), (1, 2, 2, 5, 3.0), (1, 3, 2, 7, 4.0)], columns=["one", "two", "src", "dst", "d"])
    steps = pd.DataFrame([(1, 2, 0.5, 1, 2, 1, 1, 0.5, 1, 2, 0)], columns=["one", "two", "d", "a", "b", "n_a", "n_b", "key_d", "key_a", "key_b", "key_n"])
    assert set(pieces._between(edges, steps).itertuples(index=False, name=None)) == {(1, 5, 2.0), (2, 7, 4.0)}
    nodes = pd.DataFrame([(1, 1, 1, None), (1, 2, 1, [3]), (3, 7, 1, [1]), (3, 8, 1, None)], columns=["piece", "id", "n", "others"])
    within = pd.DataFrame([(1, 1, 2, 0.5), (3, 7, 8, 0.25)], columns=["piece", "src", "dst", "d"])
    found = pieces._pieces(1.0)(nodes, within)
    assert {(r.piece, r.a, r.b, r.key_n) for r in found[found["kind"] == pieces._MERGE].itertuples()} == {(1, 1, 2, 0), (3, 7, 8, 0)}
    assert {(r.piece, r.other) for r in found[found["kind"] == pieces._REPLAY].itertuples()} == {(1, 3)}


@pytest.mark.parametrize("most", [1, 1000])
def test_labels_of_a_tree(spark, most):
    """By pointers and in one task: those of the merges in order."""
    cells, edges = graph(2, values=3, drop=0.3)
    frame = spark.createDataFrame([(i,) for i in cells], "cell_id long")
    steps = pieces.Linkage(dict.fromkeys(cells, 1), [(a, b, d) for (a, b), d in edges.items()]).merged()
    found = spark.createDataFrame([(*s[:3], *k) for s, k in zip(steps, pieces.keyed(steps), strict=True)], "d double, a long, b long, key_d double, key_a long, key_b long, key_n long")
    ks = [1, 2, 20, len(cells), 500]
    want = agglomeration.numbered(agglomeration.in_sequence(cells, [s[:3] for s in steps], ks))
    assert {tuple(r) for r in pieces.tree_labels(frame, found, ks, most).collect()} == set(want.itertuples(index=False, name=None))


def test_pieces_of_a_graph_without_edges_or_cells(spark):
    frame = spark.createDataFrame([(3,), (7,)], "cell_id long")
    none = spark.createDataFrame([], "src long, dst long, d double")
    assert {tuple(r) for r in pieces.constrained(none, frame, [1, 2], kernel=1).collect()} == {(2, 3, 0), (2, 7, 1)}
    assert pieces.constrained(none, frame.limit(0), [1]).count() == 0


def test_order_of_many_pieces_is_that_of_one_heap():
    """Equal heights: a later merge with lesser ids comes right after the one that made it possible."""
    steps = [(1.0, 3, 4, 1, 1), (1.0, 1, 3, 1, 2), (2.0, 1, 9, 3, 1)]
    assert [k[:3] for k in pieces.keyed(steps)] == [(1.0, 3, 4), (1.0, 3, 4), (2.0, 1, 9)]
