"""Outlines of clusters: the sides of cells that no other cell of the cluster shares, stitched into rings.

A cell (i, j) is the square of corners (i, j) to (i + 1, j + 1). Its sides go round it against the clock
(0 east, 1 north, 2 west, 3 south), so a cluster lies to the left of its outline: outer rings go against
the clock, holes with it. Where two cells of a cluster meet in a corner only, a ring turns left, so it
stays with its cell and rings hold what is connected by sides. Every side has one that follows it; rings
and the places of sides in them come from pointer jumping, in rounds that grow with the logarithm of the
longest ring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import stored

#: From a corner: where sides begin and end, by direction (east, north, west, south), as row and column steps from a cell's own index.
BEGINS = ((0, 0), (0, 1), (1, 1), (1, 0))
ENDS = (*BEGINS[1:], BEGINS[0])
#: The row and column of the cell beyond a side.
BEYOND = ((-1, 0), (0, 1), (1, 0), (0, -1))


def sides(cells: DataFrame, n_lon: int | None = None) -> DataFrame:
    """side (cell_id * 4 + way), cluster_id, way, i, j (where it begins), to_i, to_j: sides of cells whose neighbour beyond has another label, none, or isn't there.

    cells: cell_id (0 to 2^61), lat_idx, lon_idx, cluster_id; without a label a cell has no outline. n_lon: columns of a grid that goes
    round the globe, where column n_lon is column 0 again; None: the grid is open.
    """
    round_ = (lambda c: F.pmod(c, F.lit(n_lon)).cast("int")) if n_lon else (lambda c: c.cast("int"))
    labelled = cells.where("cluster_id is not null").select("cell_id", "cluster_id", F.col("lat_idx").cast("int").alias("i"), F.col("lon_idx").cast("int").alias("j"))
    way = lambda w: F.struct(*[F.lit(v).alias(c) for c, v in zip(("way", "b_i", "b_j", "e_i", "e_j", "o_i", "o_j"), (w, *BEGINS[w], *ENDS[w], *BEYOND[w]), strict=True)])
    every = labelled.select("cell_id", "cluster_id", "i", "j", F.explode(F.array(*[way(w) for w in range(4)])).alias("w")).select("cell_id", "cluster_id", "i", "j", "w.*")
    every = every.withColumn("other_i", F.col("i") + F.col("o_i")).withColumn("other_j", round_(F.col("j") + F.col("o_j")))
    beyond = labelled.select("cluster_id", F.col("i").alias("other_i"), F.col("j").alias("other_j"))
    kept = every.join(beyond, ["cluster_id", "other_i", "other_j"], "left_anti")
    return kept.select(
        (F.col("cell_id") * 4 + F.col("way")).alias("side"), "cluster_id", "way", (F.col("i") + F.col("b_i")).alias("i"), round_(F.col("j") + F.col("b_j")).alias("j"),
        (F.col("i") + F.col("e_i")).alias("to_i"), round_(F.col("j") + F.col("e_j")).alias("to_j"),
    )


def followers(of: DataFrame) -> DataFrame:
    """side, next: the side of the same cluster that begins where this one ends, of two the one to the left."""
    begin = of.select("cluster_id", F.col("i").alias("to_i"), F.col("j").alias("to_j"), F.col("side").alias("then"), F.col("way").alias("then_way"))
    met = of.select("side", "cluster_id", "way", "to_i", "to_j").join(begin, ["cluster_id", "to_i", "to_j"])
    # left, straight on, right
    turn = F.pmod(F.lit(1) - (F.col("then_way") - F.col("way")), F.lit(4))
    return met.groupBy("side").agg(F.min(F.struct(turn.alias("turn"), F.col("then"))).alias("x")).select("side", F.col("x.then").alias("next"))


def outlines(cells: DataFrame, n_lon: int | None = None) -> DataFrame:
    """ring_id (its least side), cluster_id, side, way, i, j: all sides of all outlines."""
    of = stored(sides(cells, n_lon))
    now = stored(followers(of).select("side", "next", F.col("side").alias("ring_id")))
    while True:
        # the least of twice as many sides from each on; where no side sees a lesser one, all see their ring's least
        ahead = now.select(F.col("side").alias("next"), F.col("next").alias("next_2"), F.col("ring_id").alias("least"))
        met = now.join(ahead, "next").select("side", F.col("next_2").alias("next"), F.least("ring_id", "least").alias("ring_id"), (F.col("least") < F.col("ring_id")).alias("moved"))
        now = stored(met)
        if not now.where("moved").limit(1).count():
            break
    return of.join(now.select("side", "ring_id"), "side").select("ring_id", "cluster_id", "side", "way", "i", "j", "to_i", "to_j")


def rings(outline: DataFrame, n_lon: int | None = None) -> DataFrame:
    """ring_id, cluster_id, n_sides, area, turns, kind of each ring of outlines().

    area: in cells, below zero for holes; the areas of a cluster's rings add up to its cells. turns: how often the ring
    goes round the globe eastwards. kind: outer, hole, or round for rings that part the globe and so have no inside of their own.
    """
    east = F.when(F.col("way") == 0, 1).when(F.col("way") == 2, -1).otherwise(0)
    r = outline.groupBy("ring_id", "cluster_id").agg(F.count(F.lit(1)).alias("n_sides"), F.sum(-east * F.col("i")).cast("long").alias("area"), F.sum(east).alias("e"))
    turns = (F.col("e") / F.lit(n_lon)).cast("int") if n_lon else F.lit(0)
    kind = F.when(turns != 0, "round").when(F.col("area") < 0, "hole").otherwise("outer")
    return r.select("ring_id", "cluster_id", "n_sides", "area", turns.alias("turns"), kind.alias("kind"))


def corners(outline: DataFrame) -> DataFrame:
    """ring_id, cluster_id, pos, i, j: the corners of each ring in order, from where its least side begins. A row a corner, so a ring may be of any length."""
    links = followers(outline).select(F.col("next").alias("side"), F.col("side").alias("back"))
    first = F.col("side") == F.col("ring_id")
    now = outline.join(links, "side").select("side", F.when(first, F.col("side")).otherwise(F.col("back")).alias("back"), F.when(first, 0).otherwise(1).cast("long").alias("pos"), first.alias("done"))
    now = stored(now)
    # who points to a first side is done: only the others ask on, so first sides aren't asked by whole rings
    firsts = outline.select(F.col("ring_id").alias("back")).distinct()
    while True:
        arrived = now.join(firsts.withColumn("at_first", F.lit(True)), "back", "left").select("side", "back", "pos", (F.col("done") | F.col("at_first").isNotNull()).alias("done"))
        now = stored(arrived)
        if not now.where(~F.col("done")).limit(1).count():
            break
        further = now.select(F.col("side").alias("back"), F.col("back").alias("back_2"), F.col("pos").alias("pos_2"))
        on = now.where(~F.col("done")).join(further, "back").select("side", F.col("back_2").alias("back"), (F.col("pos") + F.col("pos_2")).alias("pos"), "done")
        now = on.unionByName(now.where("done"))
    return outline.join(now.select("side", "pos"), "side").select("ring_id", "cluster_id", "pos", "i", "j")
