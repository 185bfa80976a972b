"""From a raw field to evaluated clusterings, with every stage kept under a key of all settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Run, seed_everything
from ..functions.geo import cos_weighted, normalise_longitude
from ..lineage import cut
from ..operators import agglomeration, centroids, linkage, modes, stencil
from ..operators.lowrank import fit
from ..operators.masks import to_series
from ..operators.pairs import edge_distances
from ..operators.reconnect import reconnect
from ..operators.regrid import bilinear
from ..operators.smoothing import spatial_then_temporal
from ..sources.sinks import cached
from . import refine


def geometry(field: DataFrame) -> tuple[float, float, float, int, bool]:
    """First latitude and longitude, resolution, columns, and whether the grid goes round the globe."""
    r = field.agg(F.min("latitude").alias("lat0"), F.min("longitude").alias("lon0"), F.max("longitude").alias("lon1"), F.max("lat_idx").alias("i"), F.max("latitude").alias("lat1"), F.max("lon_idx").alias("j")).first()
    step = (r["lat1"] - r["lat0"]) / max(1, r["i"])
    return r["lat0"], r["lon0"], step, r["j"] + 1, abs((r["j"] + 1) * step - 360) < 1e-6


def indexed(rows: DataFrame) -> DataFrame:
    """A field with indices from latitude, longitude and ts, longitudes in [-180, 180)."""
    rows = rows.withColumn("longitude", normalise_longitude(F.col("longitude")))
    axis = lambda c: rows.select(c).distinct().agg(F.array_sort(F.collect_set(c)).alias(f"{c}s"))  # noqa: E731  an axis of the grid
    out = rows
    for c, name in (("latitude", "lat_idx"), ("longitude", "lon_idx"), ("ts", "t")):
        out = out.join(F.broadcast(axis(c)), how="inner").withColumn(name, (F.array_position(f"{c}s", F.col(c)) - 1).cast("int")).drop(f"{c}s")
    width = out.agg(F.max("lon_idx")).first()[0] + 1
    return out.withColumn("cell_id", F.col("lat_idx").cast("long") * width + F.col("lon_idx")).select("cell_id", "lat_idx", "lon_idx", "t", "latitude", "longitude", "sla")


def preprocess(field: DataFrame, settings: Run) -> tuple[DataFrame, DataFrame]:
    """(filtered, unfiltered) field on the working grid: both filters, then coarsening. Neither changes the other."""
    lat0, lon0, step, n_lon, wrap = geometry(field)
    coarse: Callable[[DataFrame], DataFrame] = lambda x: bilinear(x, settings.field.resolution, lat0, lon0, step)
    filtered = field
    if settings.field.filtering:
        places = field.select("lat_idx", "lon_idx", "latitude", "longitude").distinct()
        filtered = cut(spatial_then_temporal(field, places, settings.field.half_width, n_lon, wrap))
    return coarse(filtered), coarse(field)


def initial_labels(series: DataFrame, settings: Run, n_lon: int, wrap: bool = True) -> DataFrame:
    """k, cell_id, cluster_id by the method and metric of the settings."""
    s, ks = settings.initial, list(settings.initial.n_clusters)
    if s.method == "agglomerative":
        return linkage.upgma(series, s.metric, ks)
    edges = cut(stencil.neighbours(series, n_lon=n_lon if wrap and s.method != "ward_connected" else None, seam=wrap and s.method != "ward_connected"))
    if s.method == "agglomerative_connected":
        return agglomeration.constrained(edge_distances(edges, series, s.metric), series, ks)
    if s.method == "ward_connected":
        return agglomeration.ward(series, edges, ks)
    frames = []
    for k in ks:
        labels = cut(centroids.kmeans(series, k, settings.field.random_seed))
        lines = refine.Subspaces(fit(series.select("cell_id", "x").join(labels.select("cell_id", "cluster_id"), "cell_id"), 1))
        frames.append(reconnect(series, labels, edges, lines, k).withColumn("k", F.lit(k)).select("k", "cell_id", "cluster_id"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def grid_of(series: DataFrame, places: DataFrame, n_lon: int, wrap: bool) -> refine.Grid:
    return refine.Grid(cut(series), cut(stencil.neighbours(series, n_lon=n_lon if wrap else None, seam=wrap)), cut(stencil.neighbours(series, stencil.FOUR)), cut(places), n_lon, wrap)


def evaluate(labelled: DataFrame) -> dict[str, DataFrame]:
    """Modes of each cluster and their maps, the mean first mode, and the field's first mode."""
    found = cut(modes.cluster_modes(labelled))
    return {"modes": found, "maps": modes.mode_maps(labelled, found), "mean_mode": modes.mean_first_mode(found), "field_mode": modes.field_mode(labelled)}


def run(spark: SparkSession, field: DataFrame, settings: Run) -> dict[str, DataFrame]:
    """All stages; tables under settings.field.output_path are used again if the settings are the same."""
    seed_everything(settings.field.random_seed)
    place = lambda stage: f"{settings.field.output_path}/{settings.key(stage)}"
    filtered = cached(spark, place("filtered"), lambda: preprocess(field, settings)[0])
    plain = cached(spark, place("unfiltered"), lambda: preprocess(field, settings)[1])
    _, _, _, n_lon, wrap = geometry(plain)
    series = to_series(filtered)
    out = {"initial": cached(spark, place("initial"), lambda: initial_labels(cut(series), settings, n_lon, wrap))}
    ref = settings.refinement
    weighted = plain.withColumn("sla", cos_weighted(F.col("sla"), F.col("latitude"))) if ref.weighted else plain
    working = to_series(weighted)
    labels = out["initial"].where(F.col("k") == ref.n_clusters).select("cell_id", "cluster_id")
    grid = grid_of(working, plain.select("lat_idx", "lon_idx", "latitude", "longitude").distinct(), n_lon, wrap)
    labels = cut(labels.join(grid.series.select("cell_id"), "cell_id", "left_semi"))
    results = refine.sweep(grid, labels, list(ref.strategies), list(ref.dimensions), ref.n_clusters)
    out["results"] = refine.results_frame(spark, results)
    for r in results:
        if r.labels is not None:
            out[f"labels/{r.strategy}/{r.m}"] = cached(spark, place(f"labels-{r.strategy}-{r.m}"), lambda r=r: r.labels)
            if settings.evaluation.enabled:
                labelled = working.join(r.labels, "cell_id")
                out |= {f"{name}/{r.strategy}/{r.m}": x for name, x in evaluate(labelled).items()}
    return out
