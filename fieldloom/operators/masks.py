"""Which cells have data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ("cell_id", "lat_idx", "lon_idx", "latitude", "longitude")


def cell_counts(field: DataFrame) -> DataFrame:
    """A row per cell: n_times (rows), n_values (not null)."""
    return field.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_times"), F.count("sla").alias("n_values"))


def valid_cells(field: DataFrame) -> DataFrame:
    """Cells with a value at every time."""
    return cell_counts(field).where("n_values = n_times").select(*CELL)


def any_valid_cells(field: DataFrame) -> DataFrame:
    """Cells with a value at some time, and how many."""
    return cell_counts(field).where("n_values > 0").select(*CELL, "n_values")


def gaps_by_time(field: DataFrame) -> DataFrame:
    return field.groupBy("t").agg(F.count(F.when(F.col("sla").isNull(), 1)).alias("n_missing"), F.count("sla").alias("n_present"))


def restore_gaps(filtered: DataFrame, original: DataFrame, whole_cell: bool = False) -> DataFrame:
    """filtered, null again where original is: value by value, or for all of a cell that has a gap."""
    keys = ["cell_id", "t"]
    if whole_cell:
        return filtered.join(valid_cells(original).select("cell_id", F.lit(True).alias("whole")), "cell_id", "left").withColumn("sla", F.when(F.col("whole"), F.col("sla"))).drop("whole")
    return filtered.join(original.select(*keys, F.col("sla").alias("was")), keys).withColumn("sla", F.when(F.col("was").isNotNull(), F.col("sla"))).drop("was")


def to_series(field: DataFrame) -> DataFrame:
    """Valid cells with their values in order of time."""
    got = field.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.count("sla").alias("k"), F.array_sort(F.collect_list(F.struct("t", "sla"))).alias("v"))
    return got.where("n = k").select(*CELL, F.transform("v", lambda v: v["sla"]).alias("x"))


def to_field(series: DataFrame) -> DataFrame:
    return series.select(*CELL, F.posexplode("x").alias("t", "sla"))


def masked_labels(labels: DataFrame, cells: DataFrame) -> DataFrame:
    """Labels of the given cells only."""
    return labels.join(cells.select("cell_id"), "cell_id", "left_semi")


def raster(grid: DataFrame, labels: DataFrame) -> DataFrame:
    """Every cell of the grid with its label, null where it has none."""
    return grid.join(labels.select("cell_id", "cluster_id"), "cell_id", "left")


def grid_extrema(cells: DataFrame) -> DataFrame:
    """The first and last row and column that hold cells."""
    return cells.agg(F.min("lat_idx").alias("first_row"), F.max("lat_idx").alias("last_row"), F.min("lon_idx").alias("first_column"), F.max("lon_idx").alias("last_column"))


def small_clusters(labels: DataFrame, m: int) -> DataFrame:
    """Clusters with too few cells (m or less) for a subspace of m dimensions."""
    return labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= m)


def demeaned(rows: DataFrame, key: str, value: str) -> DataFrame:
    """value less the mean of its key; null values stay null and don't count."""
    return rows.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(key)))
