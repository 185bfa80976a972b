"""Components of clusters on the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, stored
from .stencil import both_ways, undirected


def same_cluster_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """src, dst, cluster_id of edges whose ends have one label; unlabelled cells drop out."""
    end = lambda k: labels.select(F.col("cell_id").alias(k), F.col("cluster_id").alias(f"c_{k}"))
    met = edges.join(end("src"), "src").join(end("dst"), "dst")
    return met.where("c_src = c_dst").select("src", "dst", F.col("c_src").alias("cluster_id"))


def components(labels: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """cell_id, cluster_id, comp_id: comp_id is the least cell of the component of same-label neighbours.

    Every round each cell takes the least id among its own and its neighbours', then the id that the
    named cell has (a pointer jump), so a path of n cells takes about log n rounds.
    """
    links = cut(both_ways(same_cluster_edges(edges, labels).select("src", "dst")))
    now = cut(labels.select("cell_id", "cluster_id", F.col("cell_id").alias("comp_id")))
    for _ in range(max_rounds):
        near = links.join(now.select(F.col("cell_id").alias("dst"), F.col("comp_id").alias("c")), "dst").groupBy("src").agg(F.min("c").alias("c"))
        step = now.join(near.withColumnRenamed("src", "cell_id"), "cell_id", "left").select("cell_id", "cluster_id", F.col("comp_id").alias("was"), F.least("comp_id", "c").alias("c"))
        jump = step.select(F.col("cell_id").alias("c"), F.col("c").alias("further"))
        after = stored(step.join(jump, "c").select("cell_id", "cluster_id", "was", F.least("c", "further").alias("comp_id")))
        if after.where("comp_id <> was").limit(1).count() == 0:
            return after.select("cell_id", "cluster_id", "comp_id")
        now = after.select("cell_id", "cluster_id", "comp_id")
    raise RuntimeError("components did not settle")


def component_sizes(comps: DataFrame) -> DataFrame:
    return comps.groupBy("comp_id", "cluster_id").agg(F.count(F.lit(1)).alias("size"))


def smallest_component(comps: DataFrame) -> DataFrame:
    """The component with the fewest cells, of equals the one with the least id."""
    return component_sizes(comps).orderBy("size", "comp_id").limit(1)


def component_adjacency(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst: components with neighbouring cells."""
    end = lambda k: comps.select(F.col("cell_id").alias(k), F.col("comp_id").alias(f"c_{k}"))
    met = edges.join(end("src"), "src").join(end("dst"), "dst")
    return undirected(met.select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")))


def component_centres(comps: DataFrame, cells: DataFrame) -> DataFrame:
    """comp_id, latitude, longitude: medians, longitudes shifted for components on both sides of the date line."""
    placed = comps.join(cells.select("cell_id", "latitude", "longitude"), "cell_id")
    shifted = F.when(F.col("longitude") < 0, F.col("longitude") + 360).otherwise(F.col("longitude"))
    m = placed.groupBy("comp_id").agg(
        F.median("latitude").alias("latitude"), F.median("longitude").alias("plain"), F.median(shifted).alias("shifted"), ((F.min("longitude") < -170) & (F.max("longitude") > 170)).alias("across")
    )
    back = F.when(F.col("shifted") > 180, F.col("shifted") - 360).otherwise(F.col("shifted"))
    return m.select("comp_id", "latitude", F.when(F.col("across"), back).otherwise(F.col("plain")).alias("longitude"))


def neighbouring_clusters(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """cell_id, clusters: the other labels among a cell's neighbours, ascending; only cells that have some."""
    near = both_ways(edges).join(labels.select(F.col("cell_id").alias("dst"), F.col("cluster_id").alias("other")), "dst")
    met = near.join(labels.select(F.col("cell_id").alias("src"), "cluster_id"), "src").where("other <> cluster_id")
    return met.groupBy(F.col("src").alias("cell_id")).agg(F.array_sort(F.collect_set("other")).alias("clusters"))


def empty_clusters(labels: DataFrame, k: int) -> DataFrame:
    """Ids 0 .. k-1 that no cell has."""
    return labels.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id")).join(labels.select("cluster_id").distinct(), "cluster_id", "left_anti")
