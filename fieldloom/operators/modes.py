"""Angles between subspaces, and leading modes of clusters and of the field."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lowrank import _merged, no_rows, spectrum, states


#: Clusters whose bases are broadcast to be compared with each other.
MOST_CLUSTERS = 2000


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Degrees, ascending, between the row spaces of two matrices."""
    p, q = np.linalg.qr(a.T)[0], np.linalg.qr(b.T)[0]
    return np.degrees(np.arccos(np.clip(np.linalg.svd(p.T @ q, compute_uv=False), -1, 1)))


def angles(subspaces: DataFrame) -> DataFrame:
    """c1 < c2, angles of each pair of clusters: a cross join with itself of a table of k small matrices, which is checked to be small."""
    one, two = (subspaces.select(F.col("cluster_id").alias(f"c{i}"), F.col("basis").alias(f"b{i}")) for i in (1, 2))
    if two.limit(MOST_CLUSTERS + 1).count() > MOST_CLUSTERS:
        raise ValueError(f"angles are made for up to {MOST_CLUSTERS} clusters")
    met = one.crossJoin(F.broadcast(two)).where("c1 < c2")

    def run(frames):  # noqa: ANN001, ANN202
        for f in frames:
            found = [principal_angles(np.stack(a), np.stack(b)).tolist() for a, b in zip(f["b1"], f["b2"], strict=True)]
            yield pd.DataFrame({"c1": f["c1"], "c2": f["c2"], "angles": found})

    return met.select("c1", "c2", "b1", "b2").mapInPandas(run, "c1 int, c2 int, angles array<double>")


def angle_summary(found: DataFrame) -> DataFrame:
    """c1, c2, largest and mean angle (degrees) and the chordal distance."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    squares = F.transform("angles", lambda a: F.sin(F.radians(a)) * F.sin(F.radians(a)))
    return found.select("c1", "c2", F.array_max("angles").alias("largest"), F.sqrt(total(squares)).alias("chordal"), (total(F.col("angles")) / F.size("angles")).alias("mean_angle"))


def cluster_modes(labelled: DataFrame, n_modes: int = 2) -> DataFrame:
    """cluster_id, mode, t, pc: singular value times right singular vector of each cluster's series, not centred; clusters with less than two singular values are left out.

    The largest entry of a mode is positive.
    """

    def one(x: pd.DataFrame) -> pd.DataFrame:
        n, s, g = _merged(x)
        if min(n, len(s)) < 2:
            return no_rows("cluster_id", "mode", "t", "pc")
        _, values, vectors = spectrum(1, np.zeros_like(s), g)
        rows = [(x["cluster_id"].iloc[0], m + 1, t, v) for m in range(n_modes) for t, v in enumerate(np.sqrt(values[m]) * vectors[m])]
        return pd.DataFrame(rows, columns=["cluster_id", "mode", "t", "pc"])

    return states(labelled).groupBy("cluster_id").applyInPandas(one, "cluster_id int, mode int, t int, pc double")


def mode_maps(labelled: DataFrame, modes: DataFrame) -> DataFrame:
    """cell_id, cluster_id, mode, eof: the left singular vector's entry of each cell. labelled: cell_id, cluster_id, x."""
    vectors = modes.groupBy("cluster_id", "mode").agg(F.array_sort(F.collect_list(F.struct("t", "pc"))).alias("v")).select("cluster_id", "mode", F.transform("v", lambda p: p["pc"]).alias("v"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    met = labelled.join(vectors, "cluster_id")
    dot, square = total(F.zip_with("x", "v", lambda a, b: a * b)), total(F.transform("v", lambda a: a * a))
    return met.select("cell_id", "cluster_id", "mode", (dot / F.nullif(square, F.lit(0.0))).alias("eof"))


def mean_first_mode(modes: DataFrame) -> DataFrame:
    """t, pc: the mean over clusters of the first mode."""
    return modes.where("mode = 1").groupBy("t").agg(F.avg("pc").alias("pc"))


def field_mode(series: DataFrame, zero_cells: int = 0) -> DataFrame:
    """t, value: the first principal component of all cells. zero_cells: count so many cells of zeros as well, as if cells without data had none."""

    def one(x: pd.DataFrame) -> pd.DataFrame:
        n, s, g = _merged(x)
        _, _, vectors = spectrum(n + zero_cells, s, g)
        return pd.DataFrame({"t": np.arange(len(s)), "value": vectors[0]})

    return states(series.select(F.lit(0).alias("cluster_id"), "x")).groupBy("cluster_id").applyInPandas(one, "t int, value double")


def whitened(series: DataFrame, m: int) -> DataFrame:
    """cell_id, z: centred series in the first m principal directions, each with unit variance over all cells (n - 1)."""

    def one(x: pd.DataFrame) -> pd.DataFrame:
        n, s, g = _merged(x)
        mean, values, vectors = spectrum(n, s, g)
        scale = np.sqrt(np.maximum(values[:m], 0) / max(n - 1, 1))
        rows = np.divide(vectors[:m], scale[:, None], out=np.zeros_like(vectors[:m]), where=scale[:, None] > 0)
        return pd.DataFrame({"mean": [mean.tolist()], "rows": [rows.tolist()]})

    turn = states(series.select(F.lit(0).alias("cluster_id"), "x")).groupBy("cluster_id").applyInPandas(one, "mean array<double>, rows array<array<double>>")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    centred = series.select("cell_id", "x").join(F.broadcast(turn)).select("cell_id", "rows", F.zip_with("x", "mean", lambda a, b: a - b).alias("c"))
    return centred.select("cell_id", F.transform("rows", lambda r: total(F.zip_with(r, "c", lambda a, b: a * b))).alias("z"))


def against_index(mode: DataFrame, times: DataFrame, index: DataFrame) -> DataFrame:
    """ts, pc, value: a mode (t, pc) less its mean beside a climate index (ts, anomaly) of the same months. times: t, ts."""
    month = lambda c: F.date_trunc("month", c)
    centred = mode.join(times, "t").select("ts", (F.col("pc") - F.lit(mode.agg(F.avg("pc")).first()[0])).alias("pc"))
    return centred.join(index.select(month("ts").alias("m"), "anomaly"), month("ts") == F.col("m")).select("ts", "pc", F.col("anomaly").alias("value"))
