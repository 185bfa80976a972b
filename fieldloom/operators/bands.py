"""The filter on the sphere as circular convolutions of whole rows of the grid.

On a regular grid the weight between two places depends on their rows and the difference of their columns
alone. So what a row of the grid gives another one is one convolution along the row, at all times at once:
a product of Fourier transforms. A task has a band of rows, the rows in reach of it (the halo) and a block
of times; it transforms each of its rows once. Bands are twice as high as the reach, so a value travels
about twice, however many places are in its reach.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.geo import FILTER_RADIUS_KM, box_degrees, cut_off, sigma

#: Times of a task.
TIMES = 16
#: A grid of 0.01 degrees has so many rows and not quite so many places, a bit each.
MOST_ROWS, MOST_PLACES = 18_001, 1 << 30


class RowWeights:
    """Weights between the rows of a regular grid. latitudes: by row; step: degrees between columns."""

    def __init__(self, latitudes: dict[int, float], step: float, n_lon: int, half_width: float, wrap: bool, radius: float = FILTER_RADIUS_KM):
        self.latitudes, self.step, self.n_lon, self.half_width, self.wrap, self.radius = latitudes, step, n_lon, half_width, wrap, radius
        self.box = box_degrees(half_width)
        # an open row is lengthened so that what leaves it at one end doesn't come in at the other
        self.length = n_lon if wrap else n_lon + max((self.width(row) for row in latitudes if self.width(row) > 0), default=0)

    def width(self, row: int) -> int:
        """Columns to either side that a place of the row looks at; below zero beyond a pole, where it sees none, itself included."""
        reach = int(np.floor(self.box * np.cos(np.radians(self.latitudes[row])) / self.step + 1e-9)) if self.step else 0
        return min(reach, (self.n_lon - 1) // 2 if self.wrap else self.n_lon - 1)

    def near(self, row: int) -> list[int]:
        """Rows that places of this row look at."""
        return [r for r, latitude in self.latitudes.items() if abs(latitude - self.latitudes[row]) <= self.box]

    def transform(self, row: int, other: int) -> np.ndarray:
        """Of the weights of places of the other row for those of the row; real, since they are the same to either side."""
        a, b = np.radians(self.latitudes[row]), np.radians(self.latitudes[other])
        offsets = np.arange(-self.width(row), self.width(row) + 1)
        h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(offsets * self.step) / 2) ** 2
        km = 2 * self.radius * np.arcsin(np.sqrt(np.minimum(1.0, h)))
        w = np.where(km < cut_off(self.half_width), np.exp(-np.square(km) / (2 * sigma(self.half_width) ** 2)), 0.0)
        if row == other:
            w[offsets == 0] = 1.0
        line = np.zeros(self.length)
        line[offsets % self.length] = w
        return np.fft.rfft(line).real


def bands_of(weights: RowWeights) -> tuple[list[tuple[int, int]], dict[int, list[int]]]:
    """((row, band that needs it), ...) and the rows of each band. A band has twice as many rows as are in reach to one side."""
    rows = sorted(weights.latitudes)
    near = {r: weights.near(r) for r in rows}
    height = max(1, max((len(x) for x in near.values()), default=1) - 1)
    of = {b: rows[at : at + height] for b, at in enumerate(range(0, len(rows), height))}
    return sorted({(r, b) for b, own in of.items() for row in own for r in near[row]}), of


def smoothed(weights: RowWeights, targets: list[int], values: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Row to the weighted sums at its places, for each target row. values: row to its places x columns."""
    transforms = {r: np.fft.rfft(x, weights.length, axis=0) for r, x in values.items()}
    out = {}
    for row in targets:
        total = None
        for other in weights.near(row):
            if other in transforms:
                part = weights.transform(row, other)[:, None] * transforms[other]
                total = part if total is None else np.add(total, part, out=total)
        if total is not None:
            out[row] = np.fft.irfft(total, weights.length, axis=0)[: weights.n_lon]
    return out


def banded_sums(values: DataFrame, grid: DataFrame, half_width: float, n_lon: int, wrap: bool, radius: float = FILTER_RADIUS_KM, times: int = TIMES) -> DataFrame:
    """lat_idx, lon_idx, t, sla: the Gaussian mean around every value (lat_idx, lon_idx, t, sla), at its time.

    Weights add up to 1 over all places of the grid in reach, with a value or not; what has no value counts as 0.
    grid: lat_idx, lon_idx, latitude, longitude; columns are 0 .. n_lon - 1. Values outside the grid don't count.
    """
    spark = values.sparkSession
    lines = grid_rows(grid, n_lon)
    if not lines:
        return values.select("lat_idx", "lon_idx", "t", "sla").limit(0)
    step = (max(r["east"] for r in lines) - min(r["west"] for r in lines)) / max(1, max(r["last"] for r in lines) - min(r["first"] for r in lines))
    weights = RowWeights({r["lat_idx"]: r["latitude"] for r in lines}, step, n_lon, half_width, wrap, radius)
    needed, own = bands_of(weights)
    routes = F.broadcast(spark.createDataFrame(needed, "lat_idx int, band int"))
    places = spark.sparkContext.broadcast({r["lat_idx"]: bytes(r["places"]) for r in lines})
    kind = dict(values.dtypes)["t"]
    whole = values.where(F.col("sla").isNotNull() & F.col("lon_idx").between(0, n_lon - 1)).select(F.col("lat_idx").cast("int").alias("lat_idx"), F.col("lon_idx").cast("int").alias("lon_idx"), "t", F.col("sla").cast("double").alias("sla"))
    moved = whole.join(routes, "lat_idx").select("band", F.floor(F.col("t") / times).alias("block"), "lat_idx", "lon_idx", "t", "sla")

    def work(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        t, column = np.unique(x["t"].to_numpy(), return_inverse=True)
        lat, lon, v = x["lat_idx"].to_numpy(), x["lon_idx"].to_numpy(), x["sla"].to_numpy()
        arrays, there = {}, {}
        for r in {o for row in own[int(key[0])] for o in weights.near(row)}:
            at = lat == r
            a = np.zeros((n_lon, len(t) + 1))
            np.add.at(a, (lon[at], column[at]), v[at])
            inside = np.unpackbits(np.frombuffer(places.value[r], np.uint8), count=n_lon).astype(bool)
            a[~inside], a[inside, -1] = 0.0, 1.0  # the last column has the places of the grid
            arrays[r] = a
            there[r] = np.zeros((n_lon, len(t)), bool)
            there[r][lon[at], column[at]] = True
        found = [[np.empty(0, np.int32)] * 2 + [t[:0], np.empty(0)]]
        for row, sums in smoothed(weights, own[int(key[0])], arrays).items():
            at, when = np.nonzero(there[row] & (sums[:, -1:] > 1e-3))
            found.append([np.full(len(at), row, np.int32), at.astype(np.int32), t[when], sums[at, when] / sums[at, -1]])
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("lat_idx", "lon_idx", "t", "sla"), zip(*found, strict=True), strict=True)})

    return moved.groupBy("band", "block").applyInPandas(work, f"lat_idx int, lon_idx int, t {kind}, sla double")


def grid_rows(grid: DataFrame, n_lon: int) -> list[Row]:
    """lat_idx, latitude, west, east (longitudes), first, last (columns), places (a bit for each column) of every row of the grid; what the driver gets is bounded by MOST_ROWS and MOST_PLACES."""

    def row(x: pd.DataFrame) -> pd.DataFrame:
        there = np.zeros(n_lon, bool)
        there[x["lon_idx"][x["lon_idx"].between(0, n_lon - 1)].to_numpy()] = True
        ends = [f(x[c]) for c in ("longitude", "lon_idx") for f in (min, max)]
        return pd.DataFrame([(x["lat_idx"].iloc[0], x["latitude"].iloc[0], *ends, np.packbits(there).tobytes())], columns=["lat_idx", "latitude", "west", "east", "first", "last", "places"])

    n = grid.select("lat_idx").distinct().limit(MOST_ROWS + 1).count()
    if n > MOST_ROWS or n * n_lon > MOST_PLACES:
        raise ValueError(f"a grid of more than {MOST_ROWS} rows or {MOST_PLACES} places")
    rows = grid.select(F.col("lat_idx").cast("int").alias("lat_idx"), F.col("lon_idx").cast("int").alias("lon_idx"), "latitude", "longitude").groupBy("lat_idx")
    return rows.applyInPandas(row, "lat_idx int, latitude double, west double, east double, first int, last int, places binary").collect()
