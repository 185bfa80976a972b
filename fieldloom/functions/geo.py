"""Column expressions on coordinates and time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of the distance between series, and of the filters (the mean radius that haversine libraries use).
RADIUS_KM = 6371.0
FILTER_RADIUS_KM = 6371.0088
#: A Gaussian of standard deviation s has half its height at 1.178 s.
HALF_WIDTH_PER_SIGMA = 1.178
KM_PER_DEGREE = 111


def normalise_longitude(lon: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def shift_longitude(lon: Column) -> Column:
    """Into [0, 360), for shapes that cross the date line."""
    return F.when(lon < 0, lon + 360).otherwise(lon)


def index_to_coord(index: Column, origin: Column | float, resolution: float) -> Column:
    return F.lit(origin) + index * F.lit(resolution)


def coord_to_index(coord: Column, origin: Column | float, resolution: float, truncate: bool = False) -> Column:
    """The nearest index; truncate=True cuts decimals off, which loses an index to rounding now and then."""
    x = (coord - F.lit(origin)) / F.lit(resolution)
    return (x if truncate else F.round(x)).cast("int")


def cos_weighted(value: Column, latitude: Column) -> Column:
    return value * F.cos(F.radians(latitude))


def decimal_year_to_timestamp(year: Column) -> Column:
    """The start of the year plus its fraction of 365.25 days."""
    whole = F.floor(year).cast("int")
    start = F.unix_micros(F.make_timestamp(whole, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return F.timestamp_micros((start + F.round((year - whole) * 365.25 * 86_400_000_000)).cast("long"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_KM) -> Column:
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def sigma(half_width: float) -> float:
    return half_width / HALF_WIDTH_PER_SIGMA


def cut_off(half_width: float) -> float:
    return 3 * sigma(half_width)


def box_degrees(half_width: float) -> float:
    """The half side of the box of neighbours that a filter looks at."""
    return float(math.ceil(cut_off(half_width) / KM_PER_DEGREE))


def gauss_weight(distance: Column, half_width: float) -> Column:
    return F.exp(-F.pow(distance, F.lit(2.0)) / (2 * sigma(half_width) ** 2))
