"""Schemas of the tables that operators exchange. Missing values are null, never NaN; clusters are ints."""

from __future__ import annotations

FIELD = "cell_id long, lat_idx int, lon_idx int, t int, latitude double, longitude double, sla double"
SERIES = "cell_id long, lat_idx int, lon_idx int, latitude double, longitude double, x array<double>"
LABELS = "cell_id long, cluster_id int"
EDGES = "src long, dst long"
PAIRS = "i long, j long, d double"
SUBSPACES = "cluster_id int, n long, mean array<double>, basis array<array<double>>, explained double, total_ss double, residual_ss double"
TRAJECTORY = "strategy string, m int, k int, iter int, cost double"
ANGLES = "c1 int, c2 int, angles array<double>"
INDEX_1D = "station string, decimal_year double, value double"
