"""SQL of subspaces on spikes, of linkage, of k-means and of reconnecting, merge by merge."""

from __future__ import annotations

from .oracles import AXES, CELLS, COMPONENTS, EDGE_8, EDGE_8_WRAP, SPATIOTEMPORAL, STANDARD, VALUES

#: Series with one value that isn't 0, each with its mirror image: their principal axes are the times, with twice the sums of squares.
SPIKES = """spikes AS (
  SELECT vec_id, label AS c, vec_id % 64 AS p, floor(1024 * abs(CAST(embedding[(vec_id % 64 + 1)::INTEGER] AS DOUBLE))) + 1 AS v FROM embeddings
), powers AS (
  SELECT c, p, 2 * sum(v * v) AS s FROM spikes GROUP BY 1, 2
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY s DESC, p) AS r FROM powers
), sizes AS (
  SELECT c, 2 * count(*) AS n FROM spikes GROUP BY 1
), every AS (
  SELECT p, sum(s) AS s, row_number() OVER (ORDER BY sum(s) DESC, p) AS r FROM powers GROUP BY 1
)"""

#: Each spike and each cluster: its squared distance from the cluster's five axes.
NEAR = """near AS (
  SELECT a.vec_id, s.c, CASE WHEN r.p IS NULL THEN a.v * a.v ELSE 0.0 END AS d FROM spikes a CROSS JOIN sizes s LEFT JOIN ranked r ON r.c = s.c AND r.p = a.p AND r.r <= 5
)"""

KS = "(VALUES (8), (15), (25)) w(k)"


def _cut(state: str) -> str:
    """Labels at each k from state(step, cell_id, cl), clusters numbered in order of their least cells."""
    return f"""counts AS (SELECT step, count(DISTINCT cl) AS n FROM {state} GROUP BY 1), stops AS (SELECT w.k, min(c.step) AS step FROM counts c JOIN {KS} ON w.k = c.n GROUP BY 1)
SELECT CAST(a.k AS INTEGER) AS k, s.cell_id, CAST(dense_rank() OVER (PARTITION BY a.k ORDER BY s.cl) - 1 AS INTEGER) AS cluster_id FROM stops a JOIN {state} s ON s.step = a.step"""


def _merging(best: str, least: int = 8) -> str:
    """state(step, cell_id, cl): in each step the clusters a < b that `best` names become one."""
    return f"""state(step, cell_id, cl) AS (
  SELECT 0, cell_id, cell_id FROM cells
  UNION ALL
  SELECT r.step + 1, r.cell_id, CASE WHEN r.cl = m.b THEN m.a ELSE r.cl END FROM state r CROSS JOIN ({best}) m WHERE (SELECT count(DISTINCT cl) FROM state) > {least}
)"""


_AVERAGE = """SELECT least(x.cl, y.cl) AS a, greatest(x.cl, y.cl) AS b FROM pairs p JOIN state x ON x.cell_id = p.i JOIN state y ON y.cell_id = p.j
  WHERE x.cl <> y.cl GROUP BY 1, 2 ORDER BY avg(p.d), 1, 2 LIMIT 1"""

#: The growth of the sum of squares, from sums of squared distances within and between clusters.
_WARD = """SELECT u.a, u.b FROM (
    SELECT least(x.cl, y.cl) AS a, greatest(x.cl, y.cl) AS b, sum(p.d) AS s FROM pairs p JOIN state x ON x.cell_id = p.i JOIN state y ON y.cell_id = p.j GROUP BY 1, 2
  ) u JOIN (
    SELECT c.cl, count(*) AS n, any_value(coalesce(w.s, 0)) AS s FROM state c LEFT JOIN (
      SELECT x.cl, sum(p.d) AS s FROM pairs p JOIN state x ON x.cell_id = p.i JOIN state y ON y.cell_id = p.j WHERE x.cl = y.cl GROUP BY 1
    ) w ON w.cl = c.cl GROUP BY 1
  ) f ON f.cl = u.a JOIN (
    SELECT c.cl, count(*) AS n, any_value(coalesce(w.s, 0)) AS s FROM state c LEFT JOIN (
      SELECT x.cl, sum(p.d) AS s FROM pairs p JOIN state x ON x.cell_id = p.i JOIN state y ON y.cell_id = p.j WHERE x.cl = y.cl GROUP BY 1
    ) w ON w.cl = c.cl GROUP BY 1
  ) g ON g.cl = u.b {near}
  WHERE u.a <> u.b ORDER BY f.n * g.n / (f.n + g.n) * (u.s / (f.n * g.n) - f.s / (f.n * f.n) - g.s / (g.n * g.n)), 1, 2 LIMIT 1"""

_TOUCHING = """JOIN (SELECT DISTINCT least(x.cl, y.cl) AS a, greatest(x.cl, y.cl) AS b FROM edges e JOIN state x ON x.cell_id = e.src JOIN state y ON y.cell_id = e.dst WHERE x.cl <> y.cl) t ON t.a = u.a AND t.b = u.b"""

_SQUARES = "pairs AS MATERIALIZED (SELECT a.cell_id AS i, b.cell_id AS j, pow(list_distance(a.x, b.x), 2) AS d FROM cells a JOIN cells b ON a.cell_id < b.cell_id)"

#: Edges and their distances; in each step the shortest edge goes, and its ends' other edges become the lesser end's.
_CONSTRAINED = f"""links(step, a, b, d, na, nb) AS (
  SELECT 0, e.src, e.dst, {SPATIOTEMPORAL}, CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM edges e JOIN standard a ON a.cell_id = e.src JOIN standard b ON b.cell_id = e.dst
  UNION ALL
  SELECT step, least(p, q), greatest(p, q), CASE WHEN min(d) = max(d) THEN min(d) ELSE sum(d * w) / sum(w) END, any_value(CASE WHEN p < q THEN np ELSE nq END), any_value(CASE WHEN p < q THEN nq ELSE np END) FROM (
    SELECT l.step + 1 AS step, l.d, CASE WHEN l.a = m.b THEN m.a ELSE l.a END AS p, CASE WHEN l.b = m.b THEN m.a ELSE l.b END AS q,
      CASE WHEN l.a IN (m.a, m.b) THEN m.na + m.nb ELSE l.na END AS np, CASE WHEN l.b IN (m.a, m.b) THEN m.na + m.nb ELSE l.nb END AS nq,
      CASE WHEN l.a IN (m.a, m.b) THEN l.na WHEN l.b IN (m.a, m.b) THEN l.nb ELSE 1 END AS w
    FROM links l CROSS JOIN (SELECT * FROM links ORDER BY d, a, b LIMIT 1) m WHERE NOT (l.a = m.a AND l.b = m.b)
  ) x GROUP BY step, least(p, q), greatest(p, q)
), merges AS MATERIALIZED (
  SELECT step, a, b FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY d, a, b) AS n FROM links) x WHERE n = 1
), state(step, cell_id, cl) AS (
  SELECT 0, cell_id, cell_id FROM cells
  UNION ALL
  SELECT s.step + 1, s.cell_id, CASE WHEN s.cl = m.b THEN m.a ELSE s.cl END FROM state s JOIN merges m ON m.step = s.step
)"""

#: The smallest component goes to the adjacent cluster that most of its cells are nearest to, with all components of it that it touches.
_RECONNECT = """both_ways AS MATERIALIZED (
  SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges
), far AS MATERIALIZED (
  SELECT cell_id, c, d FROM axes
), state(step, cell_id, comp, cl) AS (
  SELECT 0, cell_id, comp_id, cluster_id FROM comps
  UNION ALL
  SELECT s.step + 1, s.cell_id, CASE WHEN list_contains(t.joined, s.comp) THEN list_min(t.joined) ELSE s.comp END, CASE WHEN list_contains(t.joined, s.comp) THEN t.c ELSE s.cl END
  FROM state s CROSS JOIN (
    SELECT b.c, list_append(list(a.other), any_value(b.comp)) AS joined FROM (
      SELECT comp, c FROM (
        SELECT a.comp, x.cell_id, d.c, row_number() OVER (PARTITION BY x.cell_id ORDER BY d.d, d.c) AS n
        FROM (SELECT comp FROM state GROUP BY 1 ORDER BY count(*), 1 LIMIT 1) k JOIN (
          SELECT DISTINCT x.comp, y.cl FROM both_ways l JOIN state x ON x.cell_id = l.src JOIN state y ON y.cell_id = l.dst WHERE y.comp <> x.comp
        ) a ON a.comp = k.comp JOIN state x ON x.comp = k.comp JOIN far d ON d.cell_id = x.cell_id AND d.c = a.cl
      ) v WHERE n = 1 GROUP BY 1, 2 ORDER BY count(*) DESC, 2 LIMIT 1
    ) b JOIN (
      SELECT DISTINCT x.comp, y.comp AS other, y.cl FROM both_ways l JOIN state x ON x.cell_id = l.src JOIN state y ON y.cell_id = l.dst WHERE y.comp <> x.comp
    ) a ON a.comp = b.comp AND a.cl = b.c GROUP BY 1
  ) t WHERE (SELECT count(DISTINCT comp) FROM state) > 10
), done AS (
  SELECT cell_id, comp, cl FROM state WHERE step = (SELECT max(step) FROM state)
), firsts AS (
  SELECT comp, cl, row_number() OVER (PARTITION BY cl ORDER BY comp) = 1 AS keeps FROM (SELECT DISTINCT comp, cl FROM done) x
), others AS (
  SELECT comp, row_number() OVER (ORDER BY comp) AS n FROM firsts WHERE NOT keeps
), free AS (
  SELECT i, row_number() OVER (ORDER BY i) AS n FROM range(100) g(i) WHERE i NOT IN (SELECT cl FROM done)
)"""

_UPGMA = f"pairs AS MATERIALIZED (SELECT a.cell_id AS i, b.cell_id AS j, {SPATIOTEMPORAL} AS d FROM standard a JOIN standard b ON a.cell_id < b.cell_id)"

#: From the series of the first ten cells until no cell moves.
_LLOYD = """firsts AS (
  SELECT row_number() OVER (ORDER BY cell_id) - 1 AS c, x FROM (SELECT * FROM cells ORDER BY cell_id LIMIT 10) f
), state(step, cell_id, cl, d, was) AS (
  SELECT 0, cell_id, c, d, CAST(-1 AS BIGINT) FROM (
    SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d, c) AS n FROM (
      SELECT a.cell_id, f.c, list_sum(list_transform(list_zip(a.x, f.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM cells a CROSS JOIN firsts f
    ) y
  ) z WHERE n = 1
  UNION ALL
  SELECT s.step + 1, s.cell_id, z.c, z.d, s.cl FROM state s JOIN (
    SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d, c) AS n FROM (
      SELECT v.cell_id, m.c, sum((v.sla - m.mean) * (v.sla - m.mean)) AS d FROM vals v JOIN (
        SELECT r.cl AS c, v.t, avg(v.sla) AS mean FROM state r JOIN vals v ON v.cell_id = r.cell_id GROUP BY 1, 2
      ) m ON m.t = v.t GROUP BY 1, 2
    ) y
  ) z ON z.cell_id = s.cell_id AND z.n = 1 WHERE EXISTS (SELECT 1 FROM state WHERE was <> cl)
)"""

ORACLE_SQL: dict[str, str] = {
    "cluster_subspaces": f"""WITH {SPIKES} SELECT r.c AS cluster_id, any_value(z.n) AS n, round(sum(s) FILTER (WHERE r <= 5) / sum(s), 6) AS explained, round(sum(s), 6) AS total_ss,
  round(coalesce(sum(s) FILTER (WHERE r > 5), 0), 6) AS residual_ss FROM ranked r JOIN sizes z ON z.c = r.c GROUP BY 1""",
    "subspace_cost": f"""WITH {SPIKES} SELECT CAST(m AS INTEGER) AS m, round(coalesce(sum(s) FILTER (WHERE r > m AND n > m), 0), 6) AS cost, count(DISTINCT z.c) FILTER (WHERE n <= m) AS n_unfitted
FROM (VALUES (5), (10), (15), (30)) d(m) CROSS JOIN ranked r JOIN sizes z ON z.c = r.c GROUP BY 1""",
    "explained_variance": f"WITH {SPIKES} SELECT CAST(k AS INTEGER) AS components, round(sum(s) FILTER (WHERE r <= k) / sum(s), 6) AS explained FROM (VALUES (1), (2), (5), (10), (20), (30), (40), (50)) w(k) CROSS JOIN every GROUP BY 1",
    "subspace_assignment": f"""WITH {SPIKES}, {NEAR}, best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS n FROM near)
SELECT c AS cluster_id, 2 * count(*) AS n, round(2 * sum(d), 6) AS cost FROM best WHERE n = 1 GROUP BY 1""",
    "mean_distance_by_subspace": f"WITH {SPIKES}, {NEAR} SELECT c AS cluster_id, round(avg(d), 6) AS d FROM near GROUP BY 1",
    "principal_angles": f"""WITH {SPIKES}, five AS (SELECT c, p FROM ranked WHERE r <= 5), shared AS (
  SELECT a.c AS c1, b.c AS c2, count(*) FILTER (WHERE a.p = b.p) AS k FROM five a JOIN five b ON a.c < b.c GROUP BY 1, 2
) SELECT c1, c2, CASE WHEN k < 5 THEN 90.0 ELSE 0.0 END AS largest, round(sqrt(5 - k), 6) AS chordal, (5 - k) * 18.0 AS mean_angle FROM shared""",
    "similarity_matrix": f"""WITH {SPIKES}, five AS (SELECT c, p FROM ranked WHERE r <= 5), far AS (
  SELECT a.c AS c1, b.c AS c2, sqrt(5 - count(*) FILTER (WHERE a.p = b.p)) AS d FROM five a CROSS JOIN five b GROUP BY 1, 2
) SELECT c1, {", ".join(f'round(max(CASE WHEN c2 = {c} THEN d END), 6) AS "{c}"' for c in range(10))} FROM far GROUP BY 1""",
    "cluster_modes": f"""WITH {SPIKES} SELECT c AS cluster_id, CAST(r AS INTEGER) AS mode, CAST(t AS INTEGER) AS t, round(CASE WHEN t = p THEN sqrt(s) ELSE 0.0 END, 6) AS pc
FROM ranked CROSS JOIN range(64) g(t) WHERE r <= 2""",
    "mode_maps": f"""WITH {SPIKES} SELECT 2 * a.vec_id + k AS cell_id, a.c AS cluster_id, CAST(r AS INTEGER) AS mode, round(CASE WHEN a.p = r.p THEN (1 - 2 * k) * a.v / sqrt(s) ELSE 0.0 END, 6) AS eof
FROM spikes a JOIN ranked r ON r.c = a.c CROSS JOIN range(2) g(k) WHERE r <= 2""",
    "field_mode": f"WITH {SPIKES} SELECT CAST(t AS INTEGER) AS t, CASE WHEN t = p THEN 1.0 ELSE 0.0 END AS value FROM every CROSS JOIN range(64) g(t) WHERE r = 1",
    "mean_first_mode": f"WITH {SPIKES} SELECT CAST(t AS INTEGER) AS t, round(avg(CASE WHEN t = p THEN sqrt(s) ELSE 0.0 END), 6) AS pc FROM ranked CROSS JOIN range(64) g(t) WHERE r = 1 GROUP BY 1",
    "whitened": f"""WITH {SPIKES}, n AS (SELECT 2 * count(*) AS n FROM spikes)
SELECT 2 * a.vec_id + k AS cell_id, {", ".join(f"round(max(CASE WHEN e.r = {m + 1} AND e.p = a.p THEN a.v / sqrt(e.s / (n.n - 1)) ELSE 0.0 END), 6) AS z{m}" for m in range(3))}
FROM spikes a CROSS JOIN every e CROSS JOIN n CROSS JOIN range(2) g(k) WHERE e.r <= 3 GROUP BY 1""",
    "reconnected": f"""WITH RECURSIVE {COMPONENTS}, {AXES.removeprefix(CELLS + ", ")}, {_RECONNECT}
SELECT d.cell_id, CAST(CASE WHEN f.keeps THEN d.cl ELSE e.i END AS INTEGER) AS cluster_id FROM done d JOIN firsts f ON f.comp = d.comp LEFT JOIN others o ON o.comp = d.comp LEFT JOIN free e ON e.n = o.n""",
    "upgma_labels": f"WITH RECURSIVE {CELLS}, {STANDARD}, {_UPGMA}, {_merging(_AVERAGE)}, {_cut('state')}",
    "constrained_agglo_labels": f"WITH RECURSIVE {CELLS}, {STANDARD}, {EDGE_8_WRAP}, {_CONSTRAINED}, {_cut('state')}",
    "ward_labels": f"WITH RECURSIVE {CELLS}, {_SQUARES}, {EDGE_8}, {_merging(_WARD.format(near=_TOUCHING))}, {_cut('state')}",
    "ward_unconstrained_labels": f"WITH RECURSIVE {CELLS}, {_SQUARES}, {_merging(_WARD.format(near=''))}, {_cut('state')}",
    "kmeans_labels": f"WITH RECURSIVE {CELLS}, {VALUES}, {_LLOYD} SELECT cell_id, CAST(cl AS INTEGER) AS cluster_id, round(d, 6) AS d FROM state WHERE step = (SELECT max(step) FROM state)",
}
