"""Every query of the engine by name, with its SQL where SQL can express it.

All queries run over whole tables. Grids come from the benchmark tables: vectors as cells with 64
times (their label is the initial cluster), suppliers as cells with monthly mean discounts, nations as
a coarse grid round the globe.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Refinement
from ..functions import geo
from ..functions.distances import residual
from ..lineage import cut, shared_dir
from ..operators import agglomeration, centroids, gradients, graph, linkage, lowrank, masks, modes, outlines, pairs, regrid, smoothing, stencil
from ..sources import fields, netcdf, sinks
from . import oracles, oracles_clusters, refine

Query = Callable[[SparkSession, str], DataFrame]

ORACLE_SQL = oracles.ORACLE_SQL | oracles_clusters.ORACLE_SQL

#: The embedding grid has 25 columns, two degrees apart from -79 and -24.
COLUMNS, LAT0, LON0, STEP = 25, -79.0, -24.0, 2.0
#: Of the loops in this catalogue: dimensions and clusters. They run to the operators' own caps (49 and 100).
M, K = 5, 10

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return fields.embedding_cells(spark, d)


def _labels(cells: DataFrame) -> DataFrame:
    return cells.select("cell_id", "cluster_id")


def _supplier_places(spark: SparkSession, field: DataFrame) -> DataFrame:
    """All places of the suppliers' grid: whole rows, with data or not."""
    rows = field.select("lat_idx").distinct()
    return rows.select("lat_idx", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("lon_idx")).select("lat_idx", "lon_idx", (F.lit(-75.0) + 1.5 * F.col("lat_idx")).alias("latitude"), (F.lit(-9.0) + 2.0 * F.col("lon_idx")).alias("longitude"))


def _places(cells: DataFrame) -> DataFrame:
    return cells.select("lat_idx", "lon_idx", "latitude", "longitude")


# --- masks, scalar transforms, windows -----------------------------------------------------------


@query
def valid_cells(spark: SparkSession, d: str) -> DataFrame:
    return masks.valid_cells(fields.lineitem_field(spark, d)).select("cell_id", "lat_idx", "lon_idx")


@query
def any_valid_cells(spark: SparkSession, d: str) -> DataFrame:
    return masks.any_valid_cells(fields.event_field(spark, d)).select("cell_id", "n_values")


@query
def gaps_by_time(spark: SparkSession, d: str) -> DataFrame:
    return masks.gaps_by_time(fields.event_field(spark, d))


@query
def restored_gaps(spark: SparkSession, d: str) -> DataFrame:
    field = fields.lineitem_field(spark, d)
    filled = field.withColumn("sla", F.coalesce("sla", F.lit(0.0)))
    return masks.restore_gaps(filled, field).select("cell_id", "t", r6("sla").alias("sla"))


@query
def lon_normalise(spark: SparkSession, d: str) -> DataFrame:
    cells = fields.embedding_cells(spark, d, full_circle=True)
    return cells.select("cell_id", r6(geo.normalise_longitude(F.col("longitude") * 3)).alias("longitude"), r6(geo.shift_longitude(F.col("longitude"))).alias("shifted"))


@query
def index_to_coord(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("cell_id", geo.index_to_coord(F.col("lat_idx"), LAT0, STEP).alias("latitude"), geo.index_to_coord(F.col("lon_idx"), LON0, STEP).alias("longitude"))


@query
def coord_to_index(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c, o: geo.coord_to_index(F.col(c), o, STEP)
    return _cells(spark, d).select("cell_id", at("latitude", LAT0).alias("lat_idx"), at("longitude", LON0).alias("lon_idx"))


@query
def coslat_weight(spark: SparkSession, d: str) -> DataFrame:
    return fields.lineitem_field(spark, d).where("sla is not null").select("cell_id", "t", r6(geo.cos_weighted(F.col("sla"), F.col("latitude"))).alias("sla"))


@query
def decimal_year(spark: SparkSession, d: str) -> DataFrame:
    years = fields.nation_years(spark, d).withColumn("decimal_year", F.col("year") + (F.length("station") % 4) / 4.0)
    return years.select("station", "year", F.round(F.unix_micros(geo.decimal_year_to_timestamp(F.col("decimal_year"))) / 1e6).cast("long").alias("seconds"))


@query
def demean_series(spark: SparkSession, d: str) -> DataFrame:
    return masks.demeaned(fields.nation_years(spark, d), "station", "value").select("station", "year", F.round("value", 4).alias("value"))


@query
def rolling_mean_15(spark: SparkSession, d: str) -> DataFrame:
    return smoothing.rolling_mean(fields.lineitem_field(spark, d)).select("cell_id", "t", r6("sla").alias("sla"))


@query
def gradient_time(spark: SparkSession, d: str) -> DataFrame:
    return gradients.time_gradient(masks.to_field(_cells(spark, d))).select("cell_id", "t", r6("g_time").alias("g_time"))


@query
def gradient_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return gradients.mean_magnitude(masks.to_field(_cells(spark, d))).select("cell_id", r6("magnitude").alias("magnitude"))


@query
def gradient_summary(spark: SparkSession, d: str) -> DataFrame:
    found = gradients.summary(gradients.mean_magnitude(masks.to_field(_cells(spark, d))))
    return found.select(r6("mean").alias("mean"), r6("median").alias("median"), "n")


@query
def time_slice(spark: SparkSession, d: str) -> DataFrame:
    return fields.lineitem_field(spark, d).where("t = 0").select("cell_id", r6("sla").alias("sla"))


@query
def field_union(spark: SparkSession, d: str) -> DataFrame:
    """Several files of a field as one, values at any time once."""
    field = fields.lineitem_field(spark, d)
    early, late = field.where("t < 40"), field.where("t >= 40")
    return early.unionByName(late).groupBy("t").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("sla")).alias("mean"))


@query
def netcdf_scan(spark: SparkSession, d: str) -> DataFrame:
    """The field as NetCDF files that the executors write, scanned from a time and a row on."""
    folder = f"{shared_dir(spark)}/netcdf-{uuid.uuid4().hex}"
    netcdf.write_netcdf(fields.lineitem_field(spark, d), folder)
    found = netcdf.read_netcdf(spark, folder).where("time >= 12 and lat_idx >= 1 and sla is not null")
    return found.select("cell_id", F.col("time").cast("int").alias("t"), "latitude", "longitude", r6("sla").alias("sla"))


def _orders_by_quarter(spark: SparkSession, d: str) -> DataFrame:
    when = F.col("o_orderdate")
    return fields.table(spark, d, "orders").groupBy((F.year(when) + (F.quarter(when) - 1) / 4.0).cast("double").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def _written(lines: DataFrame) -> str:
    """A folder of text files, shared by all executors."""
    folder = f"{shared_dir(lines.sparkSession)}/lines-{uuid.uuid4().hex}"
    lines.write.text(folder)
    return folder


@query
def climate_index_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a decimal year and a value, read back from 1993 on with their anomalies."""
    folder = _written(_orders_by_quarter(spark, d).select(F.format_string("  %s   %s", F.col("year").cast("string"), F.col("n").cast("string"))))
    found = fields.read_climate_index(spark, folder)
    return found.select("decimal_year", F.unix_seconds("ts").alias("seconds"), "value", r6("anomaly").alias("anomaly"))


@query
def tide_gauge_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a tide gauge, odd counts marked as missing, a heading among them."""
    value = F.when(F.col("n") % 2 == 0, F.col("n")).otherwise(F.lit(-99999))
    lines = _orders_by_quarter(spark, d).select(F.format_string(" %s;%s;N;000", F.col("year").cast("string"), value.cast("string")).alias("line"))
    heading = spark.range(1).select(F.lit("year;level;flag;mark").alias("line"))
    return fields.read_tide_gauge(spark, _written(lines.unionByName(heading)), "orders")


# --- pairs ------------------------------------------------------------------------------------------


@query
def haversine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.all_pairs(fields.nation_cells(spark, d), "haversine").select("i", "j", F.round("d", 4).alias("d"))


@query
def euclid_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.all_pairs(_cells(spark, d), "euclidean", digits=6)


@query
def abs_sum_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.all_pairs(_cells(spark, d), "abs_sum", digits=6)


@query
def spatiotemporal_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.all_pairs(_cells(spark, d), "spatiotemporal", digits=6)


@query
def pair_rms(spark: SparkSession, d: str) -> DataFrame:
    return pairs.station_rms(fields.nation_years(spark, d)).select("a", "b", "n", F.round("rms", 4).alias("rms"))


@query
def common_years(spark: SparkSession, d: str) -> DataFrame:
    return pairs.common_times(fields.nation_years(spark, d))


# --- neighbours, filters, grids --------------------------------------------------------------------


@query
def neighbours_8_wrap(spark: SparkSession, d: str) -> DataFrame:
    return stencil.neighbours(_cells(spark, d), n_lon=COLUMNS)


@query
def neighbours_8_nowrap(spark: SparkSession, d: str) -> DataFrame:
    return stencil.neighbours(_cells(spark, d))


@query
def neighbours_4(spark: SparkSession, d: str) -> DataFrame:
    return stencil.neighbours(_cells(spark, d), stencil.FOUR)


@query
def seam_edges(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours on the grid's circle, its first and last columns with data among them."""
    cells = masks.any_valid_cells(fields.lineitem_field(spark, d))
    return stencil.neighbours(cells, n_lon=10, seam=True)


@query
def grid_extrema(spark: SparkSession, d: str) -> DataFrame:
    return masks.grid_extrema(masks.valid_cells(fields.lineitem_field(spark, d)))


@query
def edge_distances(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return pairs.edge_distances(stencil.neighbours(cells, n_lon=COLUMNS), cells, "euclidean").select("src", "dst", r6("d").alias("d"))


@query
def edge_distances_spatiotemporal(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return pairs.edge_distances(stencil.neighbours(cells), cells, "spatiotemporal").select("src", "dst", r6("d").alias("d"))


@query
def radius_join(spark: SparkSession, d: str) -> DataFrame:
    """All places in reach of a cell, with normalised weights."""
    cells = _cells(spark, d)
    places = _places(cells)
    reach = stencil.in_reach(cells, stencil.radius_stencil(places, 200.0, COLUMNS, False), places, COLUMNS, False)
    return reach.select("cell_id", "to_lat", "to_lon", r6("w").alias("w"))


@query
def gauss_smooth(spark: SparkSession, d: str) -> DataFrame:
    field = fields.lineitem_field(spark, d)
    return smoothing.gauss_smooth(field, _supplier_places(spark, field), 200.0, 10, digits=None).select("cell_id", "t", r6("sla").alias("sla"))


@query
def both_filters(spark: SparkSession, d: str) -> DataFrame:
    """The filter on the sphere, then the rolling mean."""
    field = fields.lineitem_field(spark, d)
    return smoothing.spatial_then_temporal(field, _supplier_places(spark, field), 200.0, 10, wrap=False, digits=None).select("cell_id", "t", r6("sla").alias("sla"))


@query
def label_smooth(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return smoothing.smooth_labels(_labels(cells), cells, _places(cells), 200.0, COLUMNS)


@query
def bilinear_coarsen(spark: SparkSession, d: str) -> DataFrame:
    return regrid.bilinear(masks.to_field(_cells(spark, d)), 5, LAT0, LON0, STEP).where("sla is not null").select("latitude", "longitude", "t", r6("sla").alias("sla"))


@query
def bilinear_onto_axes(spark: SparkSession, d: str) -> DataFrame:
    """The embedding grid, with uneven steps, at the axes of the suppliers' places."""
    uneven = masks.to_field(_cells(spark, d)).withColumns({"latitude": F.col("latitude") + 0.5 * (F.col("lat_idx") % 2), "longitude": F.lit(LON0) + F.col("lon_idx") * (F.col("lon_idx") + 24.0) / 24.0})
    places = fields.lineitem_field(spark, d)
    axes = [regrid.axis(places, c)[c].tolist() for c in ("latitude", "longitude")]
    return regrid.bilinear_onto(uneven, *axes).where("sla is not null").select("latitude", "longitude", "t", r6("sla").alias("sla"))


@query
def nearest_regrid(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the embedding grid at the suppliers' places that have no gaps."""
    return regrid.nearest_valid_labels(_cells(spark, d).select("lat_idx", "lon_idx", "cluster_id"), fields.lineitem_field(spark, d), LAT0, LON0, STEP)


@query
def label_raster(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    found = masks.raster(cells.select("cell_id", "lat_idx", "lon_idx"), masks.masked_labels(_labels(cells), cells.where("cluster_id % 2 = 0")))
    return found.withColumn("cluster_id", F.col("cluster_id").cast("double"))


@query
def degree_summary(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    found = stencil.summary(stencil.degrees(cells, stencil.neighbours(cells)), "n")
    return found.select("least", "greatest", r6("mean").alias("mean"))


@query
def edge_distance_summary(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    found = stencil.summary(pairs.edge_distances(stencil.neighbours(cells), cells, "euclidean"), "d")
    return found.select(*[r6(c).alias(c) for c in found.columns])


# --- components -------------------------------------------------------------------------------------


def _components(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = _cells(spark, d)
    edges = stencil.neighbours(cells, n_lon=COLUMNS)
    return cells, edges, graph.components(_labels(cells), edges)


@query
def same_cluster_edges(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return graph.same_cluster_edges(stencil.neighbours(cells, n_lon=COLUMNS), _labels(cells))


@query
def components(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d)[2]


@query
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph.component_sizes(_components(spark, d)[2])


@query
def smallest_component(spark: SparkSession, d: str) -> DataFrame:
    return graph.smallest_component(_components(spark, d)[2])


@query
def component_adjacency(spark: SparkSession, d: str) -> DataFrame:
    _, edges, comps = _components(spark, d)
    return graph.component_adjacency(comps, edges)


def _outlines(spark: SparkSession, d: str) -> DataFrame:
    return outlines.outlines(_cells(spark, d).withColumn("cluster_id", F.col("cluster_id") % 2), COLUMNS)


@query
def outline_rings(spark: SparkSession, d: str) -> DataFrame:
    return outlines.rings(_outlines(spark, d), COLUMNS)


@query
def outline_corners(spark: SparkSession, d: str) -> DataFrame:
    return outlines.corners(_outlines(spark, d))


@query
def component_centres(spark: SparkSession, d: str) -> DataFrame:
    cells, _, comps = _components(spark, d)
    return graph.component_centres(comps, cells)


@query
def neighbouring_clusters(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    near = graph.neighbouring_clusters(_labels(cells), stencil.neighbours(cells, stencil.FOUR))
    return near.select("cell_id", F.array_join("clusters", ",").alias("clusters"))


@query
def dense_cluster_ids(spark: SparkSession, d: str) -> DataFrame:
    return sinks.dense_ids(_labels(_cells(spark, d)).withColumn("cluster_id", F.col("cluster_id") * 7 + 3))


@query
def empty_cluster_ids(spark: SparkSession, d: str) -> DataFrame:
    return graph.empty_clusters(_labels(_cells(spark, d)), 25)


@query
def small_clusters(spark: SparkSession, d: str) -> DataFrame:
    return masks.small_clusters(_labels(_cells(spark, d)), 50)


# --- centroids, subspaces on unit axes -----------------------------------------------------------


@query
def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    return centroids.centroids(_cells(spark, d)).select("cluster_id", "pos", r6("mean").alias("mean"), "n")


@query
def kmeans_objective(spark: SparkSession, d: str) -> DataFrame:
    return centroids.objective(_cells(spark, d)).select("cluster_id", "n", r6("objective").alias("objective"))


@query
def lloyd_step(spark: SparkSession, d: str) -> DataFrame:
    """Nearest of ten given centres, the series of the first ten cells."""
    cells = _cells(spark, d)
    return centroids.nearest_centre(cells, _first_series(cells)).select("cell_id", "cluster_id", r6("d").alias("d"))


def _first_series(cells: DataFrame) -> np.ndarray:
    """The series of the first ten cells."""
    return np.array([r["x"] for r in cells.orderBy("cell_id").limit(K).select("x").collect()])


def _axis_subspaces(cells: DataFrame) -> DataFrame:
    """cluster_id, mean, basis: through the cluster's centroid along unit axes c .. c + M - 1."""
    means = centroids.centroids(cells).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("m"))
    means = means.select("cluster_id", F.transform("m", lambda p: p["mean"]).alias("mean"))
    axis = lambda k: F.transform(F.sequence(F.lit(0), F.size("mean") - 1), lambda p: F.when(p == F.col("cluster_id") + k, 1.0).otherwise(0.0))
    return means.withColumn("basis", F.array(*[axis(k) for k in range(M)]))


def _on_axes(spark: SparkSession, d: str) -> tuple[DataFrame, lowrank.Subspaces]:
    cells = _cells(spark, d)
    unused = [F.lit(0.0).alias(c) for c in ("explained", "residual_ss")]
    return cells, lowrank.Subspaces(_axis_subspaces(cells).select("cluster_id", "mean", "basis", *unused))


@query
def residual_to_axis_subspace(spark: SparkSession, d: str) -> DataFrame:
    cells, spaces = _on_axes(spark, d)
    found = lowrank.distances(cells, spaces).select("cell_id", F.explode(F.arrays_zip("clusters", "d")).alias("x"))
    return found.select("cell_id", F.col("x.clusters").alias("cluster_id"), r6("x.d").alias("d"))


@query
def residual_expression(spark: SparkSession, d: str) -> DataFrame:
    """The same distances as a column expression, for the cluster that a cell is in."""
    cells = _cells(spark, d)
    near = cells.select("cell_id", "cluster_id", "x").join(_axis_subspaces(cells), "cluster_id")
    return near.select("cell_id", "cluster_id", r6(residual(F.col("x"), F.col("mean"), F.col("basis"))).alias("d"))


@query
def assign_axis_subspace(spark: SparkSession, d: str) -> DataFrame:
    return lowrank.assign(*_on_axes(spark, d)).select("cell_id", "cluster_id", r6("d").alias("d"))


@query
def boundary_step(spark: SparkSession, d: str) -> DataFrame:
    """One synchronous step of boundary moves towards subspaces on unit axes."""
    cells, spaces = _on_axes(spark, d)
    near = graph.neighbouring_clusters(_labels(cells), stencil.neighbours(cells, stencil.FOUR))
    return lowrank.move_boundary(cells.select("cell_id", "cluster_id", "x").join(near, "cell_id", "left"), spaces).select("cell_id", "cluster_id")


@query
def total_variance(spark: SparkSession, d: str) -> DataFrame:
    spaces = lowrank.fit(_cells(spark, d), M)
    return spaces.select("cluster_id", "n", r6("total_ss").alias("total_ss"))


# --- subspaces and modes of mirrored spikes, whose principal axes SQL can tell -----------------------


@query
def cluster_subspaces(spark: SparkSession, d: str) -> DataFrame:
    found = lowrank.fit(fields.mirrored_spikes(spark, d), M)
    return found.select("cluster_id", "n", r6("explained").alias("explained"), r6("total_ss").alias("total_ss"), r6("residual_ss").alias("residual_ss"))


@query
def subspace_cost(spark: SparkSession, d: str) -> DataFrame:
    found = lowrank.costs(fields.mirrored_spikes(spark, d), [5, 10, 15, 30])
    return found.select("m", r6("cost").alias("cost"), "n_unfitted")


@query
def explained_variance(spark: SparkSession, d: str) -> DataFrame:
    return lowrank.explained_by(fields.mirrored_spikes(spark, d), [1, 2, 5, 10, 20, 30, 40, 50]).select("components", r6("explained").alias("explained"))


@query
def subspace_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Fit a subspace to every cluster, assign every cell to the nearest, and sum the costs up."""
    cells = fields.mirrored_spikes(spark, d)
    found = lowrank.assign(cells, lowrank.Subspaces(lowrank.fit(cells, M)))
    return found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("d")).alias("cost"))


@query
def axis_rank_profile(spark: SparkSession, d: str) -> DataFrame:
    """The mean distance of cells to their nearest, second nearest, ... subspace on unit axes."""
    return lowrank.rank_profile(lowrank.distances(*_on_axes(spark, d))).select("rank", r6("d").alias("d"))


@query
def mean_distance_by_subspace(spark: SparkSession, d: str) -> DataFrame:
    cells = fields.mirrored_spikes(spark, d)
    found = lowrank.mean_distances(lowrank.distances(cells, lowrank.Subspaces(lowrank.fit(cells, M))))
    return found.select("cluster_id", r6("d").alias("d"))


def _grid(spark: SparkSession, d: str) -> tuple[refine.Grid, DataFrame]:
    cells = cut(_cells(spark, d))
    grid = refine.Grid(cells, cut(stencil.neighbours(cells, n_lon=COLUMNS)), cut(stencil.neighbours(cells, stencil.FOUR)), cut(_places(cells)), COLUMNS)
    return grid, _labels(cells)


@query
def reconnected(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reconnect import reconnect

    grid, labels = _grid(spark, d)
    return reconnect(grid.series, labels, grid.edges, _on_axes(spark, d)[1], K)


@query
def upgma_labels(spark: SparkSession, d: str) -> DataFrame:
    cells = cut(_cells(spark, d))
    return linkage.upgma(cells, "spatiotemporal", [8, 15, 25])


@query
def constrained_agglo_labels(spark: SparkSession, d: str) -> DataFrame:
    cells = cut(_cells(spark, d))
    return agglomeration.constrained(pairs.edge_distances(stencil.neighbours(cells, n_lon=COLUMNS, seam=True), cells, "spatiotemporal"), cells, [8, 15, 25])


@query
def ward_labels(spark: SparkSession, d: str) -> DataFrame:
    cells = cut(_cells(spark, d))
    return agglomeration.ward(cells, stencil.neighbours(cells), [8, 15, 25])


@query
def ward_unconstrained_labels(spark: SparkSession, d: str) -> DataFrame:
    cells = cut(_cells(spark, d))
    return linkage.ward(cells, [8, 15, 25])


@query
def kmeans_labels(spark: SparkSession, d: str) -> DataFrame:
    cells = cut(_cells(spark, d))
    return centroids.lloyd(cells, _first_series(cells))[0].select("cell_id", "cluster_id", r6("d").alias("d"))


@query
def kmeans_seeded(spark: SparkSession, d: str) -> DataFrame:
    """From centres drawn far apart."""
    return centroids.kmeans(cut(_cells(spark, d)), K).select("cell_id", "cluster_id", r6("d").alias("d"))


def _trajectory(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    grid, labels = _grid(spark, d)
    return refine.run(grid, labels, strategy, M, K).trajectory_frame(spark).withColumn("cost", r6("cost"))


@query
def iter_merge(spark: SparkSession, d: str) -> DataFrame:
    return _trajectory(spark, d, "iter_merge")


@query
def post_merge(spark: SparkSession, d: str) -> DataFrame:
    return _trajectory(spark, d, "post_merge")


@query
def smooth_merge(spark: SparkSession, d: str) -> DataFrame:
    return _trajectory(spark, d, "smooth_merge")


@query
def integrated_conn(spark: SparkSession, d: str) -> DataFrame:
    return _trajectory(spark, d, "integrated")


@query
def best_iterations(spark: SparkSession, d: str) -> DataFrame:
    grid, labels = _grid(spark, d)
    return refine.best_iterations(refine.run(grid, labels, "post_merge", M, K).trajectory_frame(spark)).withColumn("cost", r6("cost"))


@query
def explained_by_iteration(spark: SparkSession, d: str) -> DataFrame:
    grid, labels = _grid(spark, d)
    return refine.mean_explained(refine.run(grid, labels, "post_merge", M, K).explained_frame(spark)).withColumn("explained", r6("explained"))


@query
def sweep_results(spark: SparkSession, d: str) -> DataFrame:
    grid, labels = _grid(spark, d)
    found = refine.results_frame(spark, refine.sweep(grid, labels, list(Refinement.strategies), list(Refinement.dimensions), K))
    return found.withColumns({"start_cost": F.round("start_cost", 5), "best_cost": F.round("best_cost", 5)})


@query
def principal_angles(spark: SparkSession, d: str) -> DataFrame:
    found = modes.angle_summary(modes.angles(lowrank.fit(fields.mirrored_spikes(spark, d), M)))
    return found.select("c1", "c2", r6("largest").alias("largest"), r6("chordal").alias("chordal"), r6("mean_angle").alias("mean_angle"))


@query
def similarity_matrix(spark: SparkSession, d: str) -> DataFrame:
    found = modes.angle_summary(modes.angles(lowrank.fit(fields.mirrored_spikes(spark, d), M)))
    table = sinks.similarity_matrix(found, "chordal")
    return table.select("c1", *[r6(F.col(f"`{c}`")).alias(c) for c in table.columns if c != "c1"])


def _unsigned_zero(c: Column) -> Column:
    return r6(c) + F.lit(0.0)


@query
def cluster_modes(spark: SparkSession, d: str) -> DataFrame:
    return modes.cluster_modes(fields.mirrored_spikes(spark, d)).withColumn("pc", _unsigned_zero(F.col("pc")))


@query
def mean_first_mode(spark: SparkSession, d: str) -> DataFrame:
    return modes.mean_first_mode(modes.cluster_modes(fields.mirrored_spikes(spark, d))).withColumn("pc", _unsigned_zero(F.col("pc")))


@query
def mode_maps(spark: SparkSession, d: str) -> DataFrame:
    cells = fields.mirrored_spikes(spark, d)
    return modes.mode_maps(cells, modes.cluster_modes(cells)).withColumn("eof", _unsigned_zero(F.col("eof")))


@query
def field_mode(spark: SparkSession, d: str) -> DataFrame:
    return modes.field_mode(fields.mirrored_spikes(spark, d)).withColumn("value", _unsigned_zero(F.col("value")))


@query
def whitened(spark: SparkSession, d: str) -> DataFrame:
    found = modes.whitened(fields.mirrored_spikes(spark, d), 3)
    return found.select("cell_id", *[r6(F.abs(F.col("z")[k])).alias(f"z{k}") for k in range(3)])


# --- subspaces of the embedding grid: no SQL ---------------------------------------------------------


@query
def embedding_subspaces(spark: SparkSession, d: str) -> DataFrame:
    return lowrank.fit(_cells(spark, d), M).select("cluster_id", "n", r6("explained").alias("explained"), r6("residual_ss").alias("residual_ss"))


@query
def embedding_assignment(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    found = lowrank.assign(cells, lowrank.Subspaces(lowrank.fit(cells, M)))
    return found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("d")).alias("cost"))
