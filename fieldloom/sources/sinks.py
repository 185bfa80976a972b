"""Writing fields, labels and results, and not computing again what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import coord_to_index


def write_field(field: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A long field, clustered by rows of the grid, so that bands of latitude are read alone."""
    field.repartitionByRange("lat_idx").sortWithinPartitions("lat_idx", "lon_idx", "t").write.mode(mode).option("compression", "zstd").parquet(path)


def quantised(field: DataFrame, step: float = 1e-4) -> DataFrame:
    """sla as 32-bit multiples of step, as compact stores keep it."""
    return field.withColumn("sla", (F.bround(F.col("sla") / step) * step).cast("float"))


def dense_ids(labels: DataFrame) -> DataFrame:
    """cell_id, cluster_id with clusters renumbered from 0 in order of their ids. The ids alone are put in order, not the cells."""
    ids = labels.select("cluster_id").distinct().withColumn("dense", (F.dense_rank().over(Window.orderBy("cluster_id")) - 1).cast("int"))
    return labels.join(ids, "cluster_id").select("cell_id", F.col("dense").alias("cluster_id"))


def write_labels(labels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Renumbered labels; cells without one have no row."""
    dense_ids(labels).write.mode(mode).parquet(path)


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row for each strategy and dimension, costs to 5 decimals."""
    costs = [c for c, kind in results.dtypes if kind == "double"]
    results.withColumns({c: F.round(c, 5) for c in costs}).orderBy("strategy", "m").coalesce(1).write.mode(mode).option("header", True).option("sep", ";").csv(path)


def similarity_matrix(angles: DataFrame, measure: str) -> DataFrame:
    """A row for each cluster, a column for each other one, 0 on the diagonal. angles: c1, c2 and the measure."""
    both = angles.select("c1", "c2", measure).union(angles.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), measure))
    ids = both.select("c1").distinct()
    return both.union(ids.select("c1", F.col("c1").alias("c2"), F.lit(0.0).alias(measure))).groupBy("c1").pivot("c2").agg(F.first(measure)).orderBy("c1")


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], mode: str = "errorifexists") -> DataFrame:
    """The table at `path`, made and written if it isn't there. Put every setting into the path (see config.Run.key)."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        make().write.mode("overwrite" if files.exists(place) else mode).parquet(path)
    return spark.read.parquet(path)


def assign_coordinates(labels_at: DataFrame, lat0: float, lon0: float, resolution: float) -> DataFrame:
    """lat_idx, lon_idx of labels given by coordinates, by the nearest index."""
    return labels_at.withColumn("lat_idx", coord_to_index(F.col("latitude"), lat0, resolution)).withColumn("lon_idx", coord_to_index(F.col("longitude"), lon0, resolution))
