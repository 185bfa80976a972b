import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import balltree, capfilters

from .helpers import components

SCHEMA = "vec_id long, embedding array<float>, label int, v string, copies string, class_id string"


def rows(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "y", "z") for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def odd_vectors(rng, n=300, d=16):
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[10:40] = x[0] + 0.05 * rng.normal(size=(30, d)).astype(np.float32)  # near copies
    x[50:120] = x[5]  # exact ones
    x[130] = 3 * x[5]  # scaled
    x[131] = 0
    out = [list(map(float, v)) for v in x]
    out[132], out[133], out[134] = None, [math.nan] + [1.0] * (d - 1), [math.inf] * d
    out[135] = [None, *out[135][1:]]
    out[136] = []
    out[137] = [1.0, 2.0]
    return out


def is_usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize(("shard_rows", "sample", "waves"), [(64, 200, (1, 5)), (20, 1000, (1, 2, 4, 8)), (16384, 20_000, (1, 5)), (30, 3, ())])
def test_top_k_equals_brute_force(spark, shard_rows, sample, waves):
    vectors = odd_vectors(np.random.default_rng(1))
    frame = balltree.integer_vectors(rows(spark, vectors))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in balltree.top_k(frame, frame.where("vec_id % 10 = 0"), 5, shard_rows=shard_rows, leaf=8, sample=sample, waves=waves).collect()}
    whole = {i: [math.floor(256 * np.float64(np.float32(x))) for x in v] for i, v in enumerate(vectors) if is_usable(v)}
    want = {}
    for q in (i for i in whole if i % 10 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))
        want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(scored[:5])}
    assert got == want


def test_top_k_of_few_or_no_rows(spark):
    frame = balltree.integer_vectors(rows(spark, [[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]], [0, 50, 7]))
    found = balltree.top_k(frame, frame.where("vec_id % 50 = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert balltree.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_top_k_rows_that_repeat_an_id_are_all_candidates(spark):
    frame = balltree.integer_vectors(rows(spark, [[1.0, 0.0], [1.0, 0.5], [1.0, 0.5], [0.5, 1.0], [0.0, 1.0]], [0, 1, 1, 1, 2]))
    found = balltree.top_k(frame, frame.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(1, 65536), (1, 65536), (1, 32768), (2, 0)]


def test_queries_skip_shards_that_are_out_of_reach(spark):
    """Two far clusters: after the first wave no query goes to the other shard."""
    rng = np.random.default_rng(6)
    centres = 10 * np.array([[1, 0, 0, 0], [-1, 0, 0, 0]])
    x = np.concatenate([c + 0.1 * rng.normal(size=(100, 4)) for c in centres])
    frame = balltree.integer_vectors(rows(spark, x.tolist()))
    trees = balltree._top_trees(frame, 100, 1000)
    dealt = balltree._dealt(frame, trees)
    radii = {r["shard"]: r["far"] for r in dealt.groupBy("shard").agg(F.max("far").alias("far")).collect()}
    assert len(radii) == 2
    known = frame.withColumn("floor", F.lit(256.0 * 256 * 80))
    assert balltree._routed(known, trees, radii, 0, 1).count() == 200
    assert balltree._routed(known, trees, radii, 1, None).count() == 0


def test_ball_bound_never_cuts_a_better_row():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (500, 8))
    tree = balltree.BallTree(x, leaf=16)
    q = rng.integers(-50, 50, (20, 8))
    a, ids, score = tree.search(q, np.full(20, -1), np.arange(500), 3, np.full(20, -np.inf))
    for k in range(20):
        assert sorted(score[a == k])[::-1] == sorted((x @ q[k]).tolist())[::-1][:3]


def near_pairs(vectors, least):
    usable = [i for i, v in enumerate(vectors) if is_usable(v) and any(v)]
    for k, i in enumerate(usable):
        for j in usable[k + 1 :]:
            a, b = np.float64(np.float32(vectors[i])), np.float64(np.float32(vectors[j]))
            if len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                yield i, j


@pytest.mark.parametrize("group", [1024, 8])
def test_cap_filters_equal_brute_force(spark, group):
    vectors = odd_vectors(np.random.default_rng(2))
    links = list(near_pairs(vectors, 0.95))
    found = {r["vec_id"]: r for r in capfilters.near_duplicates(rows(spark, vectors), group=group).collect()}
    roots = components(len(vectors), links)
    for i in range(len(vectors)):
        assert found[i]["n_links"] == sum(i in pair for pair in links), i
        assert found[i]["component_id"] == roots[i]
        assert found[i]["kept"] == (roots[i] == i)


@pytest.mark.parametrize("mean_cosine", [0.0, 0.4, 0.64, 0.8])
def test_cap_filters_of_vectors_that_share_a_direction(spark, mean_cosine, monkeypatch):
    """No group is much larger than its bound, and links are those of brute force, among them pairs near the threshold."""
    rng = np.random.default_rng(11)
    n, d, group = 1500, 32, 64
    x = rng.normal(size=(n, d)) / math.sqrt(d)
    x = math.sqrt(1 - mean_cosine) * x + math.sqrt(mean_cosine) * np.eye(d)[0]
    y = x[:300] + 0.3 * np.linalg.norm(x[:300], axis=1, keepdims=True) * rng.normal(size=(300, d)) / math.sqrt(d)
    vectors = np.concatenate([x, y]).astype(np.float32)
    sizes = []
    made = capfilters._routed
    monkeypatch.setattr(capfilters, "_routed", lambda *a: sizes.append(made(*a)) or sizes[0])
    found = {r["vec_id"]: r["n_links"] for r in capfilters.near_duplicates(rows(spark, vectors.tolist()), group=group).collect()}
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.95).sum(axis=1) - 1
    got = np.array([found[k] for k in range(len(vectors))])
    assert (got <= want).all()
    assert got.sum() >= 0.98 * want.sum() > 0
    # blocks of one filter share a group with those of others that begin alike
    calm = sizes[0].where("low <= 0").groupBy("half", "low").count().agg(F.max("count")).first()[0]
    assert calm <= 4 * 4 * group


def test_cap_filters_recall_at_the_threshold(spark):
    """Pairs at cosine 0.95 exactly, the hardest ones to meet."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.9501 * x + math.sqrt(1 - 0.9501**2) * y
    found = capfilters.near_duplicates(rows(spark, [*x.tolist(), *z.tolist()])).where("n_links > 0").count()
    assert found >= 0.99 * 800


@pytest.mark.parametrize("bits", [11, 18, 24, 30])
def test_recall_of_codes_for_large_inputs(bits):
    """The codes of 2^11 to 2^30 vectors, on pairs at cosine 0.9501: the lists that two vectors decode to share a filter."""
    rng = np.random.default_rng(bits)
    n = 150 if bits < 30 else 60
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.9501 * x + math.sqrt(1 - 0.9501**2) * y
    c = capfilters.Code(64, 1 << bits, 40, 5)
    lists = [[set(c.decode(s, 24)[0].tolist()) for s in c.scores(v)] for v in (x, z)]
    found = np.mean([bool(a & b) for a, b in zip(*lists, strict=True)])
    assert found >= 0.95


def test_cap_filters_without_rows_or_ids(spark):
    assert capfilters.near_duplicates(rows(spark, [])).count() == 0
    found = capfilters.near_duplicates(rows(spark, [[1.0, 0.0], [1.0, 0.0], None], [None, 4, None])).collect()
    assert sorted((r["vec_id"] is None, r["n_links"], r["component_id"]) for r in found if r["n_links"]) == [(False, 1, 4), (True, 1, 4)]


def test_code_decodes_all_exceeding_directions():
    c = capfilters.Code(16, 200, 20, 1)
    rng = np.random.default_rng(random.Random(5).randint(0, 9))
    x = rng.normal(size=(5, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for s in c.scores(x):
        found, threshold = c.decode(s, 5)
        sums = s[0][:, None, None, None] + s[1][None, :, None, None] + s[2][None, None, :, None] + s[3][None, None, None, :]
        assert found.tolist() == np.flatnonzero(sums.ravel() >= threshold).tolist()
