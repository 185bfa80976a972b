"""Other grids: bilinear coarsening of fields, nearest labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .masks import masked_labels, valid_cells

#: Rows or columns that a grid may have where its axes are brought to the driver: 0.005 degrees round the globe.
AXIS = 1 << 16


def target_places(spark: SparkSession, step: int) -> DataFrame:
    """latitude, longitude of the whole-degree grid: -90 to 90 and -180 to below 180."""
    lat = spark.range(-90, 91, step).select(F.col("id").cast("double").alias("latitude"), F.floor((F.col("id") + 90) / step).cast("int").alias("lat_idx"))
    n = -(-360 // step)
    out = lat.withColumn("lon_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.select("lat_idx", "lon_idx", "latitude", (F.col("lon_idx") * step - 180).cast("double").alias("longitude"), (F.col("lat_idx").cast("long") * n + F.col("lon_idx")).alias("cell_id"))


def check_step(step: float, current: float) -> None:
    if step < current:
        raise ValueError(f"{step} degrees is finer than the field's {current}")
    if step < 1:
        raise ValueError(f"the step must be a degree or more, not {step}")


def bilinear(field: DataFrame, step: int, lat0: float, lon0: float, resolution: float) -> DataFrame:
    """The field on the whole-degree grid of `step`. The same step gives the field itself.

    A target takes the four cells around it (two or one where it lies on a line of the grid); outside
    the grid, and where one of them has no value, it has none. Four equi-joins on cell indices become
    one, by sending each target to its corners.
    """
    if step == resolution:
        return field
    check_step(step, resolution)
    spark = field.sparkSession
    fi, fj = (F.col("latitude") - lat0) / resolution, (F.col("longitude") - lon0) / resolution
    i, j = F.floor(fi).cast("int"), F.floor(fj).cast("int")
    corner = lambda di, dj: F.struct((i + di).alias("lat_idx"), (j + dj).alias("lon_idx"), ((1 - F.abs(fi - i - di)) * (1 - F.abs(fj - j - dj))).alias("w"))
    corners = F.filter(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)]), lambda c: c["w"] > 0)
    sent = target_places(spark, step).select("cell_id", F.col("lat_idx").alias("to_lat"), F.col("lon_idx").alias("to_lon"), "latitude", "longitude", F.size(corners).alias("n"), F.explode(corners).alias("c"))
    sent = sent.select("cell_id", "to_lat", "to_lon", "latitude", "longitude", "n", "c.*")
    met = sent.join(field.select("lat_idx", "lon_idx", "t", "sla"), ["lat_idx", "lon_idx"])
    out = met.groupBy("cell_id", "to_lat", "to_lon", "latitude", "longitude", "t").agg(F.sum(F.col("w") * F.col("sla")).alias("sla"), F.count("sla").alias("k"), F.first("n").alias("n"))
    return out.select("cell_id", F.col("to_lat").alias("lat_idx"), F.col("to_lon").alias("lon_idx"), "t", "latitude", "longitude", F.when(F.col("k") == F.col("n"), F.col("sla")).alias("sla"))


def axis(places: DataFrame, coordinate: str, *index: str) -> pd.DataFrame:
    """The distinct values of a coordinate, ascending, with their index if one is named; nulls are left out. More than AXIS raise."""
    found = places.select(coordinate, *index).where(F.col(coordinate).isNotNull()).distinct().limit(AXIS + 1).toPandas()
    if len(found) > AXIS:
        raise ValueError(f"{coordinate} has more than {AXIS} values; it is no axis of a grid")
    return found.sort_values(coordinate, ignore_index=True)


def _corners(source: pd.DataFrame, targets: Sequence[float], coordinate: str, index: str, to: str) -> pd.DataFrame:
    """For each target the one or two source indices around it and their weights; none outside the source."""
    at, ids = source[coordinate].to_numpy(np.float64), source[index].to_numpy(np.int64)
    if len(np.unique(at)) < len(at) or len(np.unique(ids)) < len(ids):
        raise ValueError(f"{index} and {coordinate} don't name each other")
    x = np.asarray(targets, np.float64)
    inside = np.flatnonzero((x >= at[0]) & (x <= at[-1])) if len(at) else np.empty(0, np.int64)
    low = np.searchsorted(at, x[inside], "right") - 1
    on = at[low] == x[inside]
    high = np.where(on, low, low + 1)
    part = np.where(on, 0.0, (x[inside] - at[low]) / np.where(on, 1.0, at[high] - at[low]))
    one = pd.DataFrame({to: inside, coordinate: x[inside], index: ids[low], "w": 1 - part, "k": np.where(on, 1, 2)})
    two = pd.DataFrame({to: inside, coordinate: x[inside], index: ids[high], "w": part, "k": 2})[~on]
    return pd.concat([one, two], ignore_index=True)


def bilinear_onto(field: DataFrame, latitudes: Sequence[float], longitudes: Sequence[float]) -> DataFrame:
    """The field at the places of two axes, in any order and with any steps, such as axis() gives of a clustering.

    The field's own axes may have uneven steps too. A target takes the four cells around it, two or one where
    it lies on a line of the grid; it has no rows outside the grid, and null where one of them has no value or no
    row at a time. NaN targets have no rows. Indices count the targets as given. Rows of the field meet the few
    indices around targets of their row and column, both bounded by AXIS, so the field moves only to be added up.
    """
    spark = field.sparkSession
    if max(len(latitudes), len(longitudes)) > AXIS:
        raise ValueError(f"an axis may have {AXIS} targets at most")
    near = []
    for coordinate, index, to, targets in (("latitude", "lat_idx", "to_lat", latitudes), ("longitude", "lon_idx", "to_lon", longitudes)):
        found = _corners(axis(field, coordinate, index), targets, coordinate, index, to)
        near.append(spark.createDataFrame(found, f"{to} int, {coordinate} double, {index} int, w_{index} double, k_{index} int"))
    rows = field.select("lat_idx", "lon_idx", "t", "sla")
    for found, index in zip(near, ("lat_idx", "lon_idx"), strict=True):
        rows = rows.join(F.broadcast(found), index)
    keys = ["to_lat", "to_lon", "latitude", "longitude", "t"]
    sums = rows.groupBy(*keys).agg(F.sum(F.col("sla") * F.col("w_lat_idx") * F.col("w_lon_idx")).alias("sla"), F.count("sla").alias("n"), F.first(F.col("k_lat_idx") * F.col("k_lon_idx")).alias("k"))
    cell = F.col("to_lat").cast("long") * len(longitudes) + F.col("to_lon")
    return sums.select(cell.alias("cell_id"), F.col("to_lat").alias("lat_idx"), F.col("to_lon").alias("lon_idx"), "t", "latitude", "longitude", F.when(F.col("n") == F.col("k"), F.col("sla")).alias("sla"))


def nearest_labels(labels: DataFrame, fine: DataFrame, lat0: float, lon0: float, resolution: float) -> DataFrame:
    """cell_id, cluster_id of fine cells (cell_id, latitude, longitude): the label of the nearest coarse place, halves down. labels: lat_idx, lon_idx, cluster_id."""
    near = lambda x, origin: F.ceil((F.col(x) - origin) / resolution - 0.5).cast("int")
    at = fine.select("cell_id", near("latitude", lat0).alias("lat_idx"), near("longitude", lon0).alias("lon_idx"))
    return at.join(labels.select("lat_idx", "lon_idx", "cluster_id"), ["lat_idx", "lon_idx"]).select("cell_id", "cluster_id")


def nearest_valid_labels(labels: DataFrame, fine_field: DataFrame, lat0: float, lon0: float, resolution: float) -> DataFrame:
    """As nearest_labels, for the cells of the fine field that have no gaps."""
    cells = valid_cells(fine_field)
    return masked_labels(nearest_labels(labels, cells, lat0, lon0, resolution), cells)
