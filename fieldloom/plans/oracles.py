"""The SQL of the catalogue's queries, for any engine that has lists and recursive queries."""

from __future__ import annotations

CELLS = """cells AS (
  SELECT vec_id AS cell_id, CAST(vec_id // 25 AS INTEGER) AS lat_idx, CAST(vec_id % 25 AS INTEGER) AS lon_idx,
    -79.0 + 2.0 * CAST(vec_id // 25 AS DOUBLE) AS latitude, -24.0 + 2.0 * CAST(vec_id % 25 AS DOUBLE) AS longitude,
    list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, label AS cluster_id
  FROM embeddings
)"""

FIELD = """means AS (
  SELECT l_suppkey AS cell_id, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t, avg(l_discount) AS sla
  FROM lineitem GROUP BY 1, 2
), field AS (
  SELECT c.cell_id, CAST(c.cell_id // 10 AS INTEGER) AS lat_idx, CAST(c.cell_id % 10 AS INTEGER) AS lon_idx, t.t,
    -75.0 + 1.5 * CAST(c.cell_id // 10 AS DOUBLE) AS latitude, -9.0 + 2.0 * CAST(c.cell_id % 10 AS DOUBLE) AS longitude, m.sla
  FROM (SELECT DISTINCT cell_id FROM means) c CROSS JOIN (SELECT DISTINCT t FROM means) t
  LEFT JOIN means m ON m.cell_id = c.cell_id AND m.t = t.t
), whole AS (
  SELECT cell_id, lat_idx, lon_idx, latitude, longitude FROM field GROUP BY ALL HAVING count(sla) = count(*)
)"""

EVENTS = """seen AS (
  SELECT user_id AS cell_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, avg(value) AS sla FROM events GROUP BY 1, 2
), field AS (
  SELECT c.cell_id, t.t, s.sla FROM (SELECT DISTINCT cell_id FROM seen) c CROSS JOIN (SELECT DISTINCT t FROM seen) t
  LEFT JOIN seen s ON s.cell_id = c.cell_id AND s.t = t.t
)"""

YEARS = """years AS (
  SELECT n_name AS station, CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
)"""

QUARTERS = "quarters AS (SELECT year(o_orderdate) + (quarter(o_orderdate) - 1) / 4.0 AS decimal_year, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1)"

VALUES = "vals AS (SELECT cell_id, lat_idx, lon_idx, cluster_id, generate_subscripts(x, 1) - 1 AS t, unnest(x) AS sla FROM cells)"


def _km(a: str, b: str, radius: float = 6371.0) -> str:
    return (
        f"2 * {radius} * asin(sqrt(least(1.0, pow(sin((radians({b}.latitude) - radians({a}.latitude)) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude))"
        f" * pow(sin((radians({b}.longitude) - radians({a}.longitude)) / 2), 2))))"
    )


def _r(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}.z, {b}.z), lambda p: p[1] * p[2]))"


#: Series less their mean, over the root of their sum of squares.
STANDARD = """centred AS (
  SELECT *, list_transform(x, lambda v: v - list_avg(x)) AS c FROM cells
), standard AS (
  SELECT *, list_transform(c, lambda v: v / nullif(sqrt(list_sum(list_transform(c, lambda w: w * w))), 0)) AS z FROM centred
)"""

EDGE_8_WRAP = """edges AS (
  SELECT DISTINCT least(a.cell_id, b.cell_id) AS src, greatest(a.cell_id, b.cell_id) AS dst
  FROM cells a JOIN cells b ON abs(a.lat_idx - b.lat_idx) <= 1 AND a.cell_id <> b.cell_id
    AND (a.lon_idx - b.lon_idx + 25) % 25 IN (0, 1, 24)
)"""
EDGE_8 = "edges AS (SELECT a.cell_id AS src, b.cell_id AS dst FROM cells a JOIN cells b ON abs(a.lat_idx - b.lat_idx) <= 1 AND abs(a.lon_idx - b.lon_idx) <= 1 AND a.cell_id < b.cell_id)"
EDGE_4 = "edges AS (SELECT a.cell_id AS src, b.cell_id AS dst FROM cells a JOIN cells b ON abs(a.lat_idx - b.lat_idx) + abs(a.lon_idx - b.lon_idx) = 1 AND a.cell_id < b.cell_id)"
SAME = """same AS (
  SELECT e.src, e.dst, a.cluster_id FROM edges e JOIN cells a ON a.cell_id = e.src JOIN cells b ON b.cell_id = e.dst WHERE a.cluster_id = b.cluster_id
)"""
COMPONENTS = f"""{CELLS}, {EDGE_8_WRAP}, {SAME}, links AS (
  SELECT src, dst FROM same UNION ALL SELECT dst, src FROM same
), reach(cell_id, other) AS (
  SELECT cell_id, cell_id FROM cells UNION SELECT r.cell_id, l.dst FROM reach r JOIN links l ON l.src = r.other
), comps AS (
  SELECT r.cell_id, c.cluster_id, min(r.other) AS comp_id FROM reach r JOIN cells c ON c.cell_id = r.cell_id GROUP BY 1, 2
)"""

CENTROIDS = f"{VALUES}, centroids AS (SELECT cluster_id, t AS pos, avg(sla) AS mean, count(*) AS n FROM vals GROUP BY 1, 2)"
#: Squared distance to the subspace through the centroid of cluster c along axes c .. c + 4.
AXES = f"""{CELLS}, {CENTROIDS}, axes AS (
  SELECT v.cell_id, v.cluster_id, m.cluster_id AS c,
    greatest(0.0, sum((v.sla - m.mean) * (v.sla - m.mean)) FILTER (WHERE NOT (v.t >= m.cluster_id AND v.t < m.cluster_id + 5))) AS d
  FROM vals v JOIN centroids m ON m.pos = v.t GROUP BY 1, 2, 3
)"""


def _reach(cells: str, places: str) -> str:
    """Places in reach of cells at a half width of 200 km, with normalised weights."""
    sigma, radius = "(200.0 / 1.178)", 6371.0088
    box = "ceil(3 * (200.0 / 1.178) / 111)"
    return f"""reach AS (
  SELECT a.cell_id, b.lat_idx AS to_lat, b.lon_idx AS to_lon,
    CASE WHEN a.lat_idx = b.lat_idx AND a.lon_idx = b.lon_idx THEN 1.0 ELSE exp(-pow({_km("a", "b", radius)}, 2) / (2 * pow({sigma}, 2))) END AS w
  FROM {cells} a JOIN {places} b ON abs(a.latitude - b.latitude) <= {box} AND abs(a.longitude - b.longitude) <= {box} * cos(radians(a.latitude)) + 1e-9
  WHERE {_km("a", "b", radius)} < 3 * {sigma}
), weights AS (
  SELECT cell_id, to_lat, to_lon, w / sum(w) OVER (PARTITION BY cell_id) AS w FROM reach
)"""


PAIRS = "SELECT a.cell_id AS i, b.cell_id AS j, round({d}, 6) AS d FROM {t} a JOIN {t} b ON a.cell_id < b.cell_id"
SPATIOTEMPORAL = f"1 - exp(-({_km('a', 'b')}) / (-3000 / ln(0.5))) * {_r('a', 'b')}"

#: Sides of even and odd clusters that no neighbour shares, the side that follows each, and the ring that it is of.
OUTLINES = f"""{CELLS}, places AS (SELECT cell_id, lat_idx AS i, lon_idx AS j, CAST(cluster_id % 2 AS INTEGER) AS cluster_id FROM cells WHERE cluster_id IS NOT NULL), sides AS MATERIALIZED (
  SELECT p.cell_id * 4 + w.way AS side, p.cluster_id, w.way, p.i + w.bi AS i, (p.j + w.bj) % 25 AS j, p.i + w.ei AS to_i, (p.j + w.ej) % 25 AS to_j
  FROM places p CROSS JOIN (VALUES (0, 0, 0, 0, 1, -1, 0), (1, 0, 1, 1, 1, 0, 1), (2, 1, 1, 1, 0, 1, 0), (3, 1, 0, 0, 0, 0, 24)) w(way, bi, bj, ei, ej, oi, oj)
  WHERE NOT EXISTS (SELECT 1 FROM places o WHERE o.cluster_id = p.cluster_id AND o.i = p.i + w.oi AND o.j = (p.j + w.oj) % 25)
), follow AS MATERIALIZED (
  SELECT a.side, arg_min(b.side, (a.way - b.way + 5) % 4) AS next FROM sides a JOIN sides b ON b.cluster_id = a.cluster_id AND b.i = a.to_i AND b.j = a.to_j GROUP BY 1
), walk(side, here) AS (
  SELECT side, side FROM sides UNION SELECT w.side, f.next FROM walk w JOIN follow f ON f.side = w.here
), ringed AS MATERIALIZED (SELECT side, min(here) AS ring_id FROM walk GROUP BY 1)"""

ORACLE_SQL: dict[str, str] = {
    "valid_cells": f"WITH {FIELD} SELECT cell_id, lat_idx, lon_idx FROM whole",
    "any_valid_cells": f"WITH {EVENTS} SELECT cell_id, count(sla) AS n_values FROM field GROUP BY 1 HAVING count(sla) > 0",
    "gaps_by_time": f"WITH {EVENTS} SELECT t, count(*) - count(sla) AS n_missing, count(sla) AS n_present FROM field GROUP BY 1",
    "restored_gaps": f"WITH {FIELD} SELECT cell_id, t, round(sla, 6) AS sla FROM field",
    "lon_normalise": """SELECT vec_id AS cell_id, round(((((-180.0 + 14.4 * (vec_id % 25)) * 3 + 180) % 360) + 360) % 360 - 180, 6) AS longitude,
  round(CASE WHEN -180.0 + 14.4 * (vec_id % 25) < 0 THEN 180.0 + 14.4 * (vec_id % 25) ELSE -180.0 + 14.4 * (vec_id % 25) END, 6) AS shifted FROM embeddings""",
    "index_to_coord": f"WITH {CELLS} SELECT cell_id, latitude, longitude FROM cells",
    "coord_to_index": f"WITH {CELLS} SELECT cell_id, CAST(round((latitude + 79.0) / 2.0) AS INTEGER) AS lat_idx, CAST(round((longitude + 24.0) / 2.0) AS INTEGER) AS lon_idx FROM cells",
    "coslat_weight": f"WITH {FIELD} SELECT cell_id, t, round(sla * cos(radians(latitude)), 6) AS sla FROM field WHERE sla IS NOT NULL",
    "decimal_year": f"WITH {YEARS} SELECT station, year, CAST(round(epoch(make_date(year, 1, 1)) + (length(station) % 4) / 4.0 * 365.25 * 86400) AS BIGINT) AS seconds FROM years",
    "demean_series": f"WITH {YEARS} SELECT station, year, round(value - avg(value) OVER (PARTITION BY station), 4) AS value FROM years",
    "rolling_mean_15": f"""WITH {FIELD} SELECT cell_id, t, round(CASE WHEN sla IS NOT NULL THEN
  avg(sla) OVER (PARTITION BY cell_id ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) END, 6) AS sla FROM field""",
    "gradient_time": f"""WITH {CELLS}, {VALUES}, s AS (
  SELECT *, lag(sla) OVER w AS p, lead(sla) OVER w AS n FROM vals WINDOW w AS (PARTITION BY cell_id ORDER BY t)
) SELECT cell_id, CAST(t AS INTEGER) AS t, round(CASE WHEN p IS NULL THEN n - sla WHEN n IS NULL THEN sla - p ELSE (n - p) / 2 END, 6) AS g_time FROM s""",
    "gradient_magnitude": "GRADIENT SELECT cell_id, round(magnitude, 6) AS magnitude FROM g",
    "gradient_summary": "GRADIENT SELECT round(avg(magnitude), 6) AS mean, round(median(magnitude), 6) AS median, count(*) AS n FROM g",
    "time_slice": f"WITH {FIELD} SELECT cell_id, round(sla, 6) AS sla FROM field WHERE t = 0",
    "climate_index_scan": f"""WITH {QUARTERS}, late AS (SELECT * FROM quarters WHERE decimal_year >= 1993)
SELECT decimal_year, CAST(epoch(make_date(CAST(floor(decimal_year) AS INTEGER), 1, 1)) + (decimal_year - floor(decimal_year)) * 365.25 * 86400 AS BIGINT) AS seconds, n AS value, round(n - avg(n) OVER (), 6) AS anomaly FROM late""",
    "tide_gauge_scan": f"WITH {QUARTERS} SELECT 'orders' AS station, decimal_year, CASE WHEN CAST(n AS BIGINT) % 2 = 0 THEN n END AS value FROM quarters",
    "netcdf_scan": f"WITH {FIELD} SELECT cell_id, t, latitude, longitude, round(sla, 6) AS sla FROM field WHERE t >= 12 AND lat_idx >= 1 AND sla IS NOT NULL",
    "field_union": f"WITH {FIELD} SELECT t, count(*) AS n, round(avg(sla), 6) AS mean FROM field GROUP BY 1",
    "haversine_pairs": f"""WITH cells AS (SELECT CAST(n_nationkey AS BIGINT) AS cell_id, -40.0 + 20.0 * (n_nationkey // 5) AS latitude, -180.0 + 72.0 * (n_nationkey % 5) AS longitude FROM nation)
SELECT a.cell_id AS i, b.cell_id AS j, round({_km("a", "b")}, 4) AS d FROM cells a JOIN cells b ON a.cell_id < b.cell_id""",
    "euclid_pairs": f"WITH {CELLS} " + PAIRS.format(d="list_distance(a.x, b.x)", t="cells"),
    "abs_sum_pairs": f"WITH {CELLS} " + PAIRS.format(d="abs(list_sum(a.x) - list_sum(b.x))", t="cells"),
    "spatiotemporal_pairs": f"WITH {CELLS}, {STANDARD} " + PAIRS.format(d=SPATIOTEMPORAL, t="standard"),
    "pair_rms": f"""WITH {YEARS} SELECT a.station AS a, b.station AS b, count(*) AS n, round(sqrt(avg((a.value - b.value) * (a.value - b.value))), 4) AS rms
FROM years a JOIN years b ON a.year = b.year AND a.station < b.station GROUP BY 1, 2""",
    "common_years": f"WITH {YEARS} SELECT year FROM years GROUP BY 1 HAVING count(DISTINCT station) = (SELECT count(DISTINCT station) FROM years)",
    "neighbours_8_wrap": f"WITH {CELLS}, {EDGE_8_WRAP} SELECT * FROM edges",
    "neighbours_8_nowrap": f"WITH {CELLS}, {EDGE_8} SELECT * FROM edges",
    "neighbours_4": f"WITH {CELLS}, {EDGE_4} SELECT * FROM edges",
    "seam_edges": f"""WITH {FIELD}, c AS (SELECT DISTINCT cell_id, lat_idx, lon_idx FROM field WHERE sla IS NOT NULL), e AS (SELECT min(lon_idx) AS lo, max(lon_idx) AS hi FROM c)
SELECT DISTINCT least(a.cell_id, b.cell_id) AS src, greatest(a.cell_id, b.cell_id) AS dst FROM c a JOIN c b ON abs(a.lat_idx - b.lat_idx) <= 1 AND a.cell_id <> b.cell_id CROSS JOIN e
WHERE (a.lon_idx - b.lon_idx + 10) % 10 IN (0, 1, 9) OR (a.lon_idx = e.lo AND b.lon_idx = e.hi)""",
    "grid_extrema": f"WITH {FIELD} SELECT min(lat_idx) AS first_row, max(lat_idx) AS last_row, min(lon_idx) AS first_column, max(lon_idx) AS last_column FROM whole",
    "edge_distances": f"WITH {CELLS}, {EDGE_8_WRAP} SELECT src, dst, round(list_distance(a.x, b.x), 6) AS d FROM edges JOIN cells a ON a.cell_id = src JOIN cells b ON b.cell_id = dst",
    "edge_distances_spatiotemporal": f"WITH {CELLS}, {STANDARD}, {EDGE_8} SELECT src, dst, round({SPATIOTEMPORAL}, 6) AS d FROM edges JOIN standard a ON a.cell_id = src JOIN standard b ON b.cell_id = dst",
    "degree_summary": f"""WITH {CELLS}, {EDGE_8}, links AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), n AS (
  SELECT cell_id, count(src) AS n FROM cells LEFT JOIN links ON src = cell_id GROUP BY 1
) SELECT min(n) AS least, max(n) AS greatest, round(avg(n), 6) AS mean FROM n""",
    "edge_distance_summary": f"""WITH {CELLS}, {EDGE_8}, d AS (SELECT list_distance(a.x, b.x) AS d FROM edges JOIN cells a ON a.cell_id = src JOIN cells b ON b.cell_id = dst)
SELECT round(min(d), 6) AS least, round(max(d), 6) AS greatest, round(avg(d), 6) AS mean FROM d""",
    "axis_rank_profile": f"WITH {AXES}, ranked AS (SELECT d, row_number() OVER (PARTITION BY cell_id ORDER BY d) - 1 AS n FROM axes) SELECT CAST(n AS INTEGER) AS rank, round(avg(d), 6) AS d FROM ranked GROUP BY 1",
    "radius_join": f"WITH {CELLS}, {_reach('cells', 'cells')} SELECT cell_id, to_lat, to_lon, round(w, 6) AS w FROM weights",
    "gauss_smooth": f"""WITH {FIELD}, places AS (
  SELECT r.lat_idx, CAST(j AS INTEGER) AS lon_idx, -75.0 + 1.5 * r.lat_idx AS latitude, -9.0 + 2.0 * j AS longitude FROM (SELECT DISTINCT lat_idx FROM field) r CROSS JOIN range(10) g(j)
), {_reach("whole", "places")}
SELECT w.cell_id, f.t, round(sum(w.w * f.sla), 6) AS sla FROM weights w JOIN field f ON f.lat_idx = w.to_lat AND f.lon_idx = w.to_lon WHERE f.sla IS NOT NULL GROUP BY 1, 2""",
    "both_filters": f"""WITH {FIELD}, places AS (
  SELECT r.lat_idx, CAST(j AS INTEGER) AS lon_idx, -75.0 + 1.5 * r.lat_idx AS latitude, -9.0 + 2.0 * j AS longitude FROM (SELECT DISTINCT lat_idx FROM field) r CROSS JOIN range(10) g(j)
), {_reach("whole", "places")}, smooth AS (
  SELECT w.cell_id, f.t, sum(w.w * f.sla) AS sla FROM weights w JOIN field f ON f.lat_idx = w.to_lat AND f.lon_idx = w.to_lon WHERE f.sla IS NOT NULL GROUP BY 1, 2
) SELECT cell_id, t, round(avg(sla) OVER (PARTITION BY cell_id ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 6) AS sla FROM smooth""",
    "label_smooth": f"""WITH {CELLS}, {_reach("cells", "cells")}, votes AS (
  SELECT w.cell_id, o.cluster_id, round(sum(w.w), 12) AS w FROM weights w JOIN cells o ON o.lat_idx = w.to_lat AND o.lon_idx = w.to_lon GROUP BY 1, 2
), ranked AS (
  SELECT v.cell_id, v.cluster_id, row_number() OVER (PARTITION BY v.cell_id ORDER BY v.w DESC, v.cluster_id = c.cluster_id DESC, v.cluster_id) AS n FROM votes v JOIN cells c ON c.cell_id = v.cell_id
) SELECT cell_id, cluster_id FROM ranked WHERE n = 1""",
    "bilinear_coarsen": f"""WITH {CELLS}, {VALUES}, targets AS (
  SELECT CAST(a AS DOUBLE) AS latitude, CAST(b AS DOUBLE) AS longitude, (a + 79.0) / 2.0 AS fi, (b + 24.0) / 2.0 AS fj FROM range(-90, 91, 5) y(a) CROSS JOIN range(-180, 180, 5) z(b)
), corners AS (
  SELECT latitude, longitude, CAST(floor(fi) + di AS INTEGER) AS lat_idx, CAST(floor(fj) + dj AS INTEGER) AS lon_idx, (1 - abs(fi - floor(fi) - di)) * (1 - abs(fj - floor(fj) - dj)) AS w
  FROM targets CROSS JOIN range(2) p(di) CROSS JOIN range(2) q(dj)
), used AS (
  SELECT *, count(*) OVER (PARTITION BY latitude, longitude) AS n FROM corners WHERE w > 0
)
SELECT latitude, longitude, CAST(t AS INTEGER) AS t, round(sum(w * sla), 6) AS sla FROM used JOIN vals USING (lat_idx, lon_idx) GROUP BY latitude, longitude, t, n HAVING count(sla) = n""",
    "bilinear_onto_axes": f"""WITH {CELLS}, {VALUES}, {FIELD}, ys AS (
  SELECT DISTINCT lat_idx AS i, -79.0 + 2.0 * lat_idx + 0.5 * (lat_idx % 2) AS y FROM cells
), xs AS (
  SELECT DISTINCT lon_idx AS j, -24.0 + lon_idx * (lon_idx + 24.0) / 24.0 AS x FROM cells
), lats AS (
  SELECT latitude, max(y) FILTER (y <= latitude) AS low, min(y) FILTER (y >= latitude) AS high FROM (SELECT DISTINCT latitude FROM field) CROSS JOIN ys GROUP BY 1
), lons AS (
  SELECT longitude, max(x) FILTER (x <= longitude) AS low, min(x) FILTER (x >= longitude) AS high FROM (SELECT DISTINCT longitude FROM field) CROSS JOIN xs GROUP BY 1
), by_lat AS (
  SELECT latitude, i AS lat_idx, CASE WHEN low = high THEN 1.0 WHEN y = low THEN 1 - (latitude - low) / (high - low) ELSE (latitude - low) / (high - low) END AS w, CASE WHEN low = high THEN 1 ELSE 2 END AS k FROM lats JOIN ys ON y IN (low, high) WHERE low IS NOT NULL AND high IS NOT NULL
), by_lon AS (
  SELECT longitude, j AS lon_idx, CASE WHEN low = high THEN 1.0 WHEN x = low THEN 1 - (longitude - low) / (high - low) ELSE (longitude - low) / (high - low) END AS w, CASE WHEN low = high THEN 1 ELSE 2 END AS k FROM lons JOIN xs ON x IN (low, high) WHERE low IS NOT NULL AND high IS NOT NULL
)
SELECT latitude, longitude, CAST(t AS INTEGER) AS t, round(sum(sla * a.w * b.w), 6) AS sla
FROM by_lat a CROSS JOIN by_lon b JOIN vals USING (lat_idx, lon_idx) GROUP BY latitude, longitude, t, a.k, b.k HAVING count(sla) = a.k * b.k""",
    "nearest_regrid": f"""WITH {CELLS}, {FIELD}
SELECT f.cell_id, c.cluster_id FROM whole f JOIN cells c ON c.lat_idx = CAST(ceil((f.latitude + 79.0) / 2.0 - 0.5) AS INTEGER) AND c.lon_idx = CAST(ceil((f.longitude + 24.0) / 2.0 - 0.5) AS INTEGER)""",
    "label_raster": f"WITH {CELLS} SELECT cell_id, lat_idx, lon_idx, CASE WHEN cluster_id % 2 = 0 THEN CAST(cluster_id AS DOUBLE) END AS cluster_id FROM cells",
    "same_cluster_edges": f"WITH {CELLS}, {EDGE_8_WRAP}, {SAME} SELECT * FROM same",
    "components": f"WITH RECURSIVE {COMPONENTS} SELECT * FROM comps",
    "component_sizes": f"WITH RECURSIVE {COMPONENTS} SELECT comp_id, cluster_id, count(*) AS size FROM comps GROUP BY 1, 2",
    "smallest_component": f"WITH RECURSIVE {COMPONENTS} SELECT comp_id, cluster_id, count(*) AS size FROM comps GROUP BY 1, 2 ORDER BY 3, 1 LIMIT 1",
    "component_adjacency": f"""WITH RECURSIVE {COMPONENTS} SELECT DISTINCT least(a.comp_id, b.comp_id) AS src, greatest(a.comp_id, b.comp_id) AS dst
FROM edges JOIN comps a ON a.cell_id = src JOIN comps b ON b.cell_id = dst WHERE a.comp_id <> b.comp_id""",
    "outline_rings": f"""WITH RECURSIVE {OUTLINES}, r AS (
  SELECT g.ring_id, s.cluster_id, count(*) AS n_sides, CAST(sum(CASE way WHEN 0 THEN -i WHEN 2 THEN i ELSE 0 END) AS BIGINT) AS area,
    CAST(sum(CASE way WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END) // 25 AS INTEGER) AS turns
  FROM sides s JOIN ringed g ON g.side = s.side GROUP BY 1, 2
) SELECT *, CASE WHEN turns <> 0 THEN 'round' WHEN area < 0 THEN 'hole' ELSE 'outer' END AS kind FROM r""",
    "outline_corners": f"""WITH RECURSIVE {OUTLINES}, places_in(ring_id, here, pos) AS (
  SELECT ring_id, ring_id, CAST(0 AS BIGINT) FROM ringed WHERE side = ring_id UNION ALL SELECT p.ring_id, f.next, p.pos + 1 FROM places_in p JOIN follow f ON f.side = p.here WHERE f.next <> p.ring_id
) SELECT p.ring_id, s.cluster_id, p.pos, s.i, s.j FROM places_in p JOIN sides s ON s.side = p.here""",
    "component_centres": f"""WITH RECURSIVE {COMPONENTS}, m AS (
  SELECT comp_id, median(latitude) AS latitude, median(longitude) AS plain, median(CASE WHEN longitude < 0 THEN longitude + 360 ELSE longitude END) AS shifted,
    min(longitude) < -170 AND max(longitude) > 170 AS across FROM comps JOIN cells USING (cell_id) GROUP BY 1
) SELECT comp_id, latitude, CASE WHEN NOT across THEN plain WHEN shifted > 180 THEN shifted - 360 ELSE shifted END AS longitude FROM m""",
    "neighbouring_clusters": f"""WITH {CELLS}, {EDGE_4}, links AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), near AS (
  SELECT DISTINCT a.cell_id, b.cluster_id FROM links JOIN cells a ON a.cell_id = src JOIN cells b ON b.cell_id = dst WHERE a.cluster_id <> b.cluster_id
) SELECT cell_id, string_agg(CAST(cluster_id AS VARCHAR), ',' ORDER BY cluster_id) AS clusters FROM near GROUP BY 1""",
    "dense_cluster_ids": f"WITH {CELLS} SELECT cell_id, CAST(dense_rank() OVER (ORDER BY cluster_id) - 1 AS INTEGER) AS cluster_id FROM cells",
    "empty_cluster_ids": "SELECT CAST(i AS INTEGER) AS cluster_id FROM range(25) g(i) WHERE i NOT IN (SELECT label FROM embeddings)",
    "small_clusters": "SELECT label AS cluster_id, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) <= 50",
    "cluster_centroids": f"WITH {CELLS}, {CENTROIDS} SELECT cluster_id, CAST(pos AS INTEGER) AS pos, round(mean, 6) AS mean, n FROM centroids",
    "kmeans_objective": f"""WITH {CELLS}, {CENTROIDS} SELECT v.cluster_id, max(m.n) AS n, round(sum((v.sla - m.mean) * (v.sla - m.mean)), 6) AS objective
FROM vals v JOIN centroids m ON m.cluster_id = v.cluster_id AND m.pos = v.t GROUP BY 1""",
    "lloyd_step": f"""WITH {CELLS}, c AS (SELECT CAST(row_number() OVER (ORDER BY cell_id) - 1 AS INTEGER) AS k, x FROM cells ORDER BY cell_id LIMIT 10), s AS (
  SELECT a.cell_id, c.k, list_sum(list_transform(list_zip(a.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM cells a CROSS JOIN c
), ranked AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d, k) AS n FROM s)
SELECT cell_id, k AS cluster_id, round(d, 6) AS d FROM ranked WHERE n = 1""",
    "residual_to_axis_subspace": f"WITH {AXES} SELECT cell_id, c AS cluster_id, round(d, 6) AS d FROM axes",
    "residual_expression": f"WITH {AXES} SELECT cell_id, c AS cluster_id, round(d, 6) AS d FROM axes WHERE c = cluster_id",
    "assign_axis_subspace": f"WITH {AXES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d, c) AS n FROM axes) SELECT cell_id, c AS cluster_id, round(d, 6) AS d FROM ranked WHERE n = 1",
    "boundary_step": f"""WITH {AXES}, {EDGE_4}, links AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), near AS (
  SELECT DISTINCT a.cell_id, b.cluster_id AS c FROM links JOIN cells a ON a.cell_id = src JOIN cells b ON b.cell_id = dst
  UNION SELECT cell_id, cluster_id FROM cells
), ranked AS (
  SELECT x.cell_id, x.c, row_number() OVER (PARTITION BY x.cell_id ORDER BY x.d, x.c <> x.cluster_id, x.c) AS n FROM axes x JOIN near USING (cell_id, c)
) SELECT cell_id, c AS cluster_id FROM ranked WHERE n = 1""",
    "total_variance": f"""WITH {CELLS}, {CENTROIDS} SELECT v.cluster_id, max(m.n) AS n, round(sum((v.sla - m.mean) * (v.sla - m.mean)), 6) AS total_ss
FROM vals v JOIN centroids m ON m.cluster_id = v.cluster_id AND m.pos = v.t GROUP BY 1""",
}

_GRADIENT = f"""WITH {CELLS}, {VALUES}, s AS (
  SELECT cell_id, sla, lag(sla) OVER a AS tp, lead(sla) OVER a AS tn, lag(sla) OVER b AS yp, lead(sla) OVER b AS yn, lag(sla) OVER c AS xp, lead(sla) OVER c AS xn FROM vals
  WINDOW a AS (PARTITION BY cell_id ORDER BY t), b AS (PARTITION BY lon_idx, t ORDER BY lat_idx), c AS (PARTITION BY lat_idx, t ORDER BY lon_idx)
), d AS (
  SELECT cell_id, CASE WHEN tp IS NULL THEN tn - sla WHEN tn IS NULL THEN sla - tp ELSE (tn - tp) / 2 END AS gt,
    CASE WHEN yp IS NULL THEN yn - sla WHEN yn IS NULL THEN sla - yp ELSE (yn - yp) / 2 END AS gy,
    CASE WHEN xp IS NULL THEN xn - sla WHEN xn IS NULL THEN sla - xp ELSE (xn - xp) / 2 END AS gx FROM s
), g AS (SELECT cell_id, avg(sqrt(gt * gt + gy * gy + gx * gx)) AS magnitude FROM d GROUP BY 1)"""
ORACLE_SQL = {k: v.replace("GRADIENT", _GRADIENT) for k, v in ORACLE_SQL.items()}
