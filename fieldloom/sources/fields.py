"""Fields made from the benchmark tables, and reading fields and one-dimensional series from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import decimal_year_to_timestamp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- derived fields ----------------------------------------------------------------------------


def embedding_cells(spark: SparkSession, sf_dir: str, full_circle: bool = False) -> DataFrame:
    """series + cluster_id: every vector is a cell of a grid with 25 columns."""
    lon = F.lit(-180.0) + 14.4 * F.col("lon_idx") if full_circle else F.lit(-24.0) + 2.0 * F.col("lon_idx")
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("cell_id"),
        F.floor(F.col("vec_id") / 25).cast("int").alias("lat_idx"),
        (F.col("vec_id") % 25).cast("int").alias("lon_idx"),
        F.transform("embedding", lambda x: x.cast("double")).alias("x"),
        F.col("label").alias("cluster_id"),
    ).select("cell_id", "lat_idx", "lon_idx", (F.lit(-79.0) + 2.0 * F.col("lat_idx")).alias("latitude"), lon.alias("longitude"), "x", "cluster_id")


def mirrored_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, x, cluster_id: for every vector two series that are 0 but for one time, where one has a whole number and the other its negative.

    Means are 0 and scatters diagonal, so the principal axes of any set of pairs are the times themselves.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("cluster_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("mirror"))
    size = lambda v: (F.floor(1024 * F.abs(v.cast("double"))) + 1) * (1 - 2 * F.col("mirror"))
    x = F.transform("embedding", lambda v, i: F.when(i == F.col("vec_id") % F.size("embedding"), size(v).cast("double")).otherwise(0.0))
    return e.select((2 * F.col("vec_id") + F.col("mirror")).alias("cell_id"), x.alias("x"), "cluster_id")


def lineitem_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field: a supplier is a cell, its monthly mean discount the value; months without one are null."""
    ship = F.col("l_shipdate")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), ((F.year(ship) - 1995) * 12 + F.month(ship) - 1).cast("int").alias("t")).agg(F.avg("l_discount").alias("sla"))
    return _on_grid(rows, 10, -75.0, 1.5, -9.0, 2.0)


def event_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field: a user is a cell, the daily mean value the value; has many gaps."""
    first = F.lit("2024-01-01").cast("timestamp")
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell_id"), F.floor((F.unix_timestamp("ts") - F.unix_timestamp(first)) / 86400).cast("int").alias("t")).agg(F.avg("value").alias("sla"))
    return _on_grid(rows, 10, -75.0, 1.5, -9.0, 2.0)


def _on_grid(rows: DataFrame, columns: int, lat0: float, dlat: float, lon0: float, dlon: float) -> DataFrame:
    """Every cell at every time that occurs anywhere: an outer grid of two short lists, not of the rows."""
    cells, times = rows.select("cell_id").distinct(), rows.agg(F.array_sort(F.collect_set("t")).alias("ts"))
    grid = cells.join(F.broadcast(times)).select("cell_id", F.explode("ts").alias("t"))
    full = grid.join(rows, ["cell_id", "t"], "left")
    full = full.withColumn("lat_idx", F.floor(F.col("cell_id") / columns).cast("int")).withColumn("lon_idx", (F.col("cell_id") % columns).cast("int"))
    return full.select("cell_id", "lat_idx", "lon_idx", "t", (F.lit(lat0) + dlat * F.col("lat_idx")).alias("latitude"), (F.lit(lon0) + dlon * F.col("lon_idx")).alias("longitude"), F.nanvl("sla", F.lit(None).cast("double")).alias("sla"))


def nation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, latitude, longitude of the nations on a coarse grid round the globe."""
    n = F.col("n_nationkey")
    lat_idx, lon_idx = F.floor(n / 5).cast("int"), (n % 5).cast("int")
    return table(spark, sf_dir, "nation").select(n.cast("long").alias("cell_id"), lat_idx.alias("lat_idx"), lon_idx.alias("lon_idx"), (F.lit(-40.0) + 20.0 * lat_idx).alias("latitude"), (F.lit(-180.0) + 72.0 * lon_idx).alias("longitude"), F.array().cast("array<double>").alias("x"))


def nation_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, year, value: mean order price of a nation and year."""
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    x = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy(F.col("n_name").alias("station"), F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("value"))


# --- files -----------------------------------------------------------------------------------------


def read_fields(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """Files of a long field as one: order comes from `t`, not from file names. NaN becomes null."""
    reader = spark.read.schema(schema) if schema else spark.read
    frame = reader.parquet(*paths)
    doubles = [c for c, kind in frame.dtypes if kind in ("double", "float")]
    return frame.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})


def read_climate_index(spark: SparkSession, path: str, first_year: int = 1993) -> DataFrame:
    """ts, decimal_year, value, anomaly from lines of a decimal year and a value; years before first_year are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.try_element_at(parts, F.lit(1)).try_cast("double").alias("decimal_year"), F.try_element_at(parts, F.lit(2)).try_cast("double").alias("value"))
    rows = rows.where("decimal_year is not null").withColumn("ts", decimal_year_to_timestamp(F.col("decimal_year"))).where(F.year("ts") >= first_year)
    return rows.select("ts", "decimal_year", "value", (F.col("value") - F.avg("value").over(Window.partitionBy())).alias("anomaly"))


def read_tide_gauge(spark: SparkSession, path: str, station: str, missing: float = -99999.0) -> DataFrame:
    """station, decimal_year, value from `decimal year; value; ...` lines. Lines that don't parse are skipped; the missing mark is null. A file that isn't there raises."""
    rows = spark.read.csv(path, sep=";", schema="a string, b string, c string, d string", mode="PERMISSIVE")
    rows = rows.select(F.trim("a").try_cast("double").alias("decimal_year"), F.trim("b").try_cast("double").alias("value")).where("decimal_year is not null and value is not null")
    return rows.select(F.lit(station).alias("station"), "decimal_year", F.nullif("value", F.lit(missing)).alias("value"))


def read_trajectories(spark: SparkSession, path: str, strategy: str | None = None, m: int | None = None, k: int | None = None) -> DataFrame:
    """Costs by iteration, of one strategy, dimension or number of clusters where given."""
    rows = spark.read.parquet(path)
    for name, value in (("strategy", strategy), ("m", m), ("k", k)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def read_netcdf(spark: SparkSession, path: str, variable: str = "sla") -> DataFrame:
    """The long field of NetCDF files, one task a file. Needs the netCDF4 package on the executors; without it, convert to Parquet first."""
    try:
        import netCDF4  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading NetCDF needs the netCDF4 package; Parquet is the store of fields here") from e

    def rows(frames):  # noqa: ANN001, ANN202
        import netCDF4
        import numpy as np
        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                with netCDF4.Dataset("field", memory=bytes(content)) as data:
                    lat, lon, time = (np.asarray(data[n][:]) for n in ("latitude", "longitude", "time"))
                    for k, t in enumerate(time):
                        values = np.ma.filled(data[variable][k].astype("float64"), np.nan)
                        i, j = np.indices(values.shape)
                        yield pd.DataFrame({"lat_idx": i.ravel(), "lon_idx": j.ravel(), "time": float(t), "latitude": lat[i.ravel()], "longitude": lon[j.ravel()], "sla": values.ravel()})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(rows, "lat_idx int, lon_idx int, time double, latitude double, longitude double, sla double")
