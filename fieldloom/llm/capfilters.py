"""Embedding near-dedup with spherical-cap filters from structured random product codes.

A filter is a direction; a vector is in it if their inner product exceeds a threshold. The directions
are a product code: the space is rotated and cut into blocks, each block has a few random unit
vectors, and every combination of one from each block is a direction. List-decoding finds all
exceeding directions of a vector from its few scores per block, without going through the
combinations. Vectors in one filter are compared there by their exact cosine.

A vector with fewer than `least` exceeding directions takes its best `least`. With about 40
directions a vector, a pair at cosine 0.95 rarely shares none; directions of a product code share
words, so the chance grows a little with the code. Measured on pairs at 0.9501 in 64 dimensions: all
found up to 2^17 vectors, 0.98 and more from 2^21 to 2^30.

A vector travels once for each first half of its directions, with the second halves beside it, so the
filters that begin alike are compared where their vectors are already. Where very many vectors share a
first half, as they do if all have a direction in common, they are dealt out by their second halves too;
filters in which very many vectors meet are dealt over pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, cut, parallelism, reused
from .components import components, forest
from .vectors import by_dimension, usable

BLOCKS = 4


class Code:
    """The product code for vectors of one dimension, for about `n` vectors, each in about `per_vector` filters."""

    def __init__(self, dimension: int, n: int, per_vector: int, seed: int):
        rng = np.random.default_rng([seed, dimension])
        self.width = -(-dimension // BLOCKS)
        share = min(0.05, 2.0 / max(n, 1))
        self.size = max(4, int(np.ceil((per_vector / share) ** (1 / BLOCKS))))
        # the score of a random unit vector is about normal with variance 1 / dimension
        self.least_score = -NormalDist().inv_cdf(share) / np.sqrt(self.width * BLOCKS)
        self.turn = np.linalg.qr(rng.normal(size=(self.width * BLOCKS, self.width * BLOCKS)))[0][:dimension]
        words = rng.normal(size=(BLOCKS, self.size, self.width))
        self.words = words / np.linalg.norm(words, axis=2, keepdims=True) / np.sqrt(BLOCKS)

    def scores(self, unit: np.ndarray) -> np.ndarray:
        """Row, block, word of the block: its part of the score. A row's figures don't depend on the rows beside it."""
        turned = np.einsum("nd,de->ne", unit, self.turn).reshape(len(unit), BLOCKS, self.width)
        return np.stack([np.einsum("nw,cw->nc", turned[:, b], self.words[b]) for b in range(BLOCKS)], axis=1)

    def decode(self, scores: np.ndarray, least: int) -> tuple[np.ndarray, float]:
        """All filters of one row (ascending) and the threshold that they exceed."""
        left = (scores[0][:, None] + scores[1][None, :]).ravel()
        right = (scores[2][:, None] + scores[3][None, :]).ravel()
        most_left, most_right, threshold = left.max(), right.max(), self.least_score
        while True:
            i, j = np.flatnonzero(left >= threshold - most_right), np.flatnonzero(right >= threshold - most_left)
            x, y = np.nonzero(left[i][:, None] + right[j][None, :] >= threshold)
            if len(x) >= min(least, self.size**BLOCKS):
                return np.sort(i[x].astype(np.int64) * self.size**2 + j[y]), threshold
            threshold -= 0.02


@lru_cache(maxsize=16)
def code(dimension: int, n: int, per_vector: int, seed: int) -> Code:
    return Code(dimension, n, per_vector, seed)


def _decoded(classes: DataFrame, n: int, per_vector: int, least: int, seed: int) -> DataFrame:
    """class_id, copies, v, filters. A filter's number also tells the vectors' dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                found: list = [None] * batch.num_rows
                for rows, x in by_dimension(batch.column(2)):
                    c = code(x.shape[1], n, per_vector, seed)
                    scores = c.scores(_unit(x))
                    for r, s in zip(rows.tolist(), scores, strict=True):
                        found[r] = c.decode(s, least)[0] * 4099 + x.shape[1] % 4099
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], ["class_id", "copies", "v", "filters"])

    kind = dict(classes.dtypes)["v"]
    return classes.select("class_id", "copies", "v").mapInArrow(run, f"class_id long, copies long, v {kind}, filters array<long>")


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big  # components near the ends of the range don't overflow when squared
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _owned(a: np.ndarray, b: np.ndarray, scores: np.ndarray, lists: list[np.ndarray], c: Code, number: np.ndarray) -> np.ndarray:
    """Whether `number` is the one filter, of those that rows a and b of each pair share, that counts the pair.

    That is the filter nearest to their sum if both are in it, else the least shared one.
    """
    best = (scores[a] + scores[b]).argmax(axis=2)
    top = ((best[:, 0] * c.size + best[:, 1]) * c.size**2 + best[:, 2] * c.size + best[:, 3]).astype(np.int64)
    every = c.size**BLOCKS
    held = np.concatenate(lists) + np.repeat(np.arange(len(lists)), [len(x) for x in lists]) * every  # ascending

    def has(row: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(held, row * every + top), len(held) - 1)
        return held[at] == row * every + top

    shared = has(a) & has(b)
    out = shared & (number == top)
    for k in np.flatnonzero(~shared).tolist():
        out[k] = number[k] == np.intersect1d(lists[a[k]], lists[b[k]], assume_unique=True)[0]
    return out


def _met(x: pd.DataFrame, size: int) -> Iterator[tuple[np.ndarray, int, int, int]]:
    """(rows, filter, low, high) of each filter in which at least two rows of x meet. x: half, low, high, ends (second halves of directions), in order of the first three."""
    ends = x["ends"].to_numpy()
    counts = np.fromiter(map(len, ends), np.int64, len(ends))
    row, end = np.repeat(np.arange(len(x)), counts), np.concatenate(ends)
    half, low, high = x["half"].to_numpy(np.int64), x["low"].to_numpy(np.int64), x["high"].to_numpy(np.int64)
    order = np.lexsort((end, high[row], low[row], half[row]))
    row, end = row[order], end[order]
    key = np.stack([half[row], low[row], high[row], end])
    starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(row)], strict=True):
        if e - s > 1:
            yield row[s:e], int(key[0, s] // 4099 * size**2 + end[s]), int(key[1, s]), int(key[2, s])


def _compare(routed: DataFrame, n: int, per_vector: int, least: int, seed: int, cosine: float) -> DataFrame:
    """kind 0: (class a, links found b); kind 1: an edge of a spanning forest between classes a and b.

    routed: half (the first half of a direction and the dimension), low, high, side, class_id, copies, v, ends.
    """

    def work(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, copies = x["class_id"].to_numpy(), x["copies"].to_numpy()
        side = x["side"].to_numpy()
        flat = np.concatenate(x["v"].to_numpy()).astype(np.float64)
        lengths = x["v"].map(len).to_numpy()
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        for d in np.unique(lengths):
            c = code(int(d), n, per_vector, seed)
            own = np.flatnonzero(lengths == d)
            u = _unit(flat[offsets[own][:, None] + np.arange(d)])
            decoded: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by class, however many filters it is met in here

            def settled(a: np.ndarray, b: np.ndarray, number: int) -> Iterator[pd.DataFrame]:
                """What the pairs count for that this filter owns."""
                used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                fresh = [r for r in used.tolist() if ids[own[r]] not in decoded]  # noqa: B023
                for r, score in zip(fresh, c.scores(u[fresh]) if fresh else (), strict=True):  # noqa: B023
                    decoded[ids[own[r]]] = (score, c.decode(score, least)[0])  # noqa: B023
                found = [decoded[k] for k in ids[own[used]].tolist()]  # noqa: B023
                scores, lists = np.stack([x for x, _ in found]), [x for _, x in found]
                keep = _owned(at[: len(a)], at[len(a) :], scores, lists, c, np.full(len(a), number))  # noqa: B023
                i, j = own[a[keep]], own[b[keep]]  # noqa: B023
                if len(i):
                    rows, at = np.unique(np.concatenate([ids[i], ids[j]]), return_inverse=True)
                    yield pd.DataFrame({"kind": 0, "a": rows, "b": np.bincount(at, weights=np.concatenate([copies[j], copies[i]])).astype(np.int64)})
                    p, q = forest(ids[i], ids[j])
                    yield pd.DataFrame({"kind": 1, "a": p, "b": q})

            for met, f, low, high in _met(x.iloc[own], c.size):
                p, q = (met, met) if low == high else (met[side[own[met]] == low], met[side[own[met]] == high])
                for s in range(0, len(p), 64):  # a stripe's pairs at once
                    i, j = np.nonzero(u[p[s : s + 64]] @ u[q].T >= cosine)
                    if low == high:
                        i, j = i[j > i + s], j[j > i + s]
                    if len(i):
                        yield from settled(p[s + i], q[j], f)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows whose last group may go on
        group = ["half", "low", "high"]
        for x in frames:
            keys = x[group].to_numpy()
            cutting = len(x) - int((keys == keys[-1]).all(axis=1).sum())
            if held and (cutting or (held[-1][group].iloc[-1].to_numpy() != keys[-1]).any()):
                yield from work(pd.concat([*held, x.iloc[:cutting]], ignore_index=True))
                held = []
            elif cutting:
                yield from work(x.iloc[:cutting].reset_index(drop=True))
            held.append(x.iloc[cutting:])
        if held:
            yield from work(pd.concat(held, ignore_index=True))

    return routed.mapInPandas(run, "kind int, a long, b long")


def _routed(placed: DataFrame, classes: DataFrame, n: int, per_vector: int, group: int, seed: int) -> DataFrame:
    """Where vectors are compared: half, low, high, side, class_id, copies, v, ends. placed: class_id, copies, v, filters, split (the blocks of crowded filters).

    No group (half, low, high) has many more than 4 * `group` vectors: a first half in which more filters meet is
    dealt out by second halves, a single filter of more than `group` by pairs of blocks.
    """
    # a filter's number is (first half * size^2 + second half) * 4099 + dimension mod 4099; the size follows from the vectors' length
    sizes = F.create_map(*[F.lit(x) for d in [r["d"] for r in classes.select(F.size("v").alias("d")).distinct().collect()] for x in (d, code(d, n, per_vector, seed).size ** 2)])
    square = F.try_element_at(sizes, F.size("v")).cast("long")
    first, second = (lambda f: F.floor(F.floor(f / 4099) / square)), (lambda f: F.floor(f / 4099) % square)
    dimension = F.size("v") % 4099
    calm = placed.withColumn("filters", F.filter("filters", lambda f: ~F.map_contains_key("split", f)))
    firsts = F.array_distinct(F.transform("filters", lambda f: first(f)))
    ends = lambda h: F.transform(F.filter("filters", lambda f: first(f) == h), lambda f: second(f))
    halves = calm.select("class_id", F.explode(F.transform(firsts, lambda h: F.struct((h * 4099 + dimension).alias("half"), F.size(ends(h)).alias("n")))).alias("x")).select("class_id", "x.half", "x.n")
    full = reused(halves.groupBy("half").agg(F.sum("n").alias("n")).where(F.col("n") > 4 * group).select("half", F.ceil(F.col("n") / (4 * group)).cast("int").alias("deals")))
    deals = halves.join(full, "half").groupBy("class_id").agg(F.map_from_entries(F.collect_list(F.struct("half", "deals"))).alias("deals"))
    calm = calm.join(deals, "class_id", "left").select("class_id", "copies", "v", "filters", "deals", F.explode(firsts).alias("first")).withColumn("half", F.col("first") * 4099 + dimension)
    calm = calm.withColumns({"ends": ends(F.col("first")), "deals": F.coalesce(F.try_element_at("deals", "half"), F.lit(1))})
    deal = lambda e: F.pmod(F.xxhash64(e), F.col("deals")).cast("int")
    calm = calm.select("half", "class_id", "copies", "v", "ends", "deals", F.explode(F.array_distinct(F.transform("ends", deal))).alias("deal"))
    own = -F.col("deal")
    calm = calm.select("half", own.alias("low"), own.alias("high"), own.alias("side"), "class_id", "copies", "v", F.filter("ends", lambda e: deal(e) == F.col("deal")).alias("ends"))
    hot = placed.select("class_id", "copies", "v", F.explode("split").alias("filter", "blocks"))
    hot = hot.withColumn("side", F.pmod(F.xxhash64("class_id", "filter"), F.col("blocks")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # blocks are numbered apart from those of other filters with the same first half, by sorting the rows by these too
    hot = hot.select((first(F.col("filter")) * 4099 + dimension).alias("half"), (F.least("side", "to") + 1).alias("low"), (F.greatest("side", "to") + 1).alias("high"), (F.col("side") + 1).alias("side"), "class_id", "copies", "v", F.array(second(F.col("filter"))).alias("ends"))
    return calm.unionByName(hot)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, per_vector: int = 40, least: int = 24, group: int = 1024, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding).

    Equal vectors are one class, compared once, whatever their number; n_links counts their copies.
    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, not
    even with their like; vectors of different lengths don't link. A filter with more than `group`
    classes is split into blocks, compared pair by pair of blocks. Rows without a vec_id take part and
    count; their component_id is that of the others, null if there are none. No rows in, no rows out.
    """
    spark = vectors.sparkSession
    rows = columns_of(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v")) & F.exists("v", lambda x: x != 0), F.col("v")))
    classes = cut(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    # the classes are numbered where they lie, in the checkpoint; rows find theirs by two digests of the vector
    digests = [F.xxhash64("v").alias("one"), F.xxhash64(F.lit(1), "v").alias("two")]
    classes = classes.select(F.monotonically_increasing_id().alias("class_id"), "v", "first_id", "copies")
    n = classes.count()
    parts = max(parallelism(spark), 2 * spark.sparkContext.defaultParallelism)
    n = 1 << max(0, int(n) - 1).bit_length()  # the same code for inputs of about the same size
    decoded = reused(_decoded(classes.repartition(parts, "class_id"), n, per_vector, least, seed))
    members = decoded.select("class_id", F.explode("filters").alias("filter"))
    crowded = members.groupBy("filter").count().where(F.col("count") > group).select("filter", F.ceil(F.col("count") / group).cast("int").alias("blocks"))
    crowded = reused(crowded)
    split = members.join(crowded, "filter").groupBy("class_id").agg(F.map_from_entries(F.collect_list(F.struct("filter", "blocks"))).alias("split"))
    placed = decoded.join(split, "class_id", "left").withColumn("split", F.coalesce("split", F.create_map().cast("map<bigint,int>")))
    found = cut(_compare(_routed(placed, classes, n, per_vector, group, seed).repartition(parts, "half", "low", "high").sortWithinPartitions("half", "low", "high"), n, per_vector, least, seed, cosine))
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("others"))
    roots = components(found.where("kind = 1").select("a", "b"))
    labelled = classes.select("class_id", "first_id", "copies").join(counts.withColumnRenamed("a", "class_id"), "class_id", "left").join(roots.withColumnRenamed("node", "class_id"), "class_id", "left")
    labelled = cut(labelled.select("class_id", "first_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class_id").alias("root")))
    ids = cut(labelled.groupBy("root").agg(F.min("first_id").alias("component_id")))
    of_class = cut(labelled.join(ids, "root").select("class_id", "n_links", "component_id"))
    of_vector = of_class.join(classes.select("class_id", *digests), "class_id").select("one", "two", "class_id", "n_links", "component_id")
    known = [F.when(F.col("v").isNotNull(), d).alias(k) for k, d in zip(("one", "two"), digests, strict=True)]
    out = rows.select("vec_id", *known).join(of_vector, ["one", "two"], "left")
    component = F.when(F.col("class_id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
