"""Discrete gradients: central differences inside, one-sided ones at the ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _difference(value: str, over: Window) -> Column:
    before, after, x = F.lag(value).over(over), F.lead(value).over(over), F.col(value)
    has_before, has_after = F.lag(F.lit(1)).over(over).isNotNull(), F.lead(F.lit(1)).over(over).isNotNull()
    return F.when(has_before & has_after, (after - before) / 2).when(has_after, after - x).when(has_before, x - before)


def gradients(field: DataFrame) -> DataFrame:
    """g_time, g_lat, g_lon of every value of a field on a full rectangle of cells, per step of index."""
    along_time = Window.partitionBy("lat_idx", "lon_idx").orderBy("t")
    along_lat = Window.partitionBy("lon_idx", "t").orderBy("lat_idx")
    along_lon = Window.partitionBy("lat_idx", "t").orderBy("lon_idx")
    return field.withColumns({"g_time": _difference("sla", along_time), "g_lat": _difference("sla", along_lat), "g_lon": _difference("sla", along_lon)})


def time_gradient(field: DataFrame) -> DataFrame:
    return field.withColumn("g_time", _difference("sla", Window.partitionBy("cell_id").orderBy("t")))


def mean_magnitude(field: DataFrame) -> DataFrame:
    """cell_id, magnitude: the mean over time of the length of the gradient."""
    length = F.sqrt(F.col("g_time") * F.col("g_time") + F.col("g_lat") * F.col("g_lat") + F.col("g_lon") * F.col("g_lon"))
    return gradients(field).groupBy("cell_id").agg(F.avg(length).alias("magnitude"))


def magnitude_at(field: DataFrame, t: int = 0) -> DataFrame:
    """cell_id, magnitude of the gradient in space at one time."""
    g = gradients(field.where(F.col("t") == t))
    return g.select("cell_id", F.sqrt(F.col("g_lat") * F.col("g_lat") + F.col("g_lon") * F.col("g_lon")).alias("magnitude"))


def summary(magnitudes: DataFrame) -> DataFrame:
    return magnitudes.agg(F.avg("magnitude").alias("mean"), F.median("magnitude").alias("median"), F.count("magnitude").alias("n"))
