"""SQL of the filter audit, the product codes and the benchmark passages."""

from __future__ import annotations

from .audit import FILTERS
from .productcodes import ENTRIES, PARTS, ROUNDS, SCALE

_WORD = r"[^\x20\x09-\x0D]+"


def _audit() -> str:
    letters = "unnest(['" + "','".join(FILTERS) + "'])"
    return rf"""WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), t AS (
  SELECT text, min(doc_id) AS first FROM d GROUP BY 1
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN d.doc_id > t.first THEN 'E' ELSE '' END AS fails
  FROM d JOIN t USING (text) LEFT JOIN l ON l.doc_id = d.doc_id
), c AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2
), f AS (
  SELECT {letters} AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, left(filter_order, CAST(step - 1 AS INTEGER)) AS before FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders) x
), seen AS (
  SELECT *, len(list_filter(string_split(fails, ''), lambda x: contains(before, x) AND x <> '')) > 0 AS gone, contains(fails, letter) AS failing FROM c, steps
), counted AS (
  SELECT part, filter_order, step, letter,
    CAST(sum(n) FILTER (WHERE NOT gone AND NOT failing) AS BIGINT) AS kept, CAST(sum(n) FILTER (WHERE NOT gone AND failing) AS BIGINT) AS removed,
    CAST(sum(n) FILTER (WHERE gone AND failing) AS BIGINT) AS redundant, CAST(sum(n) FILTER (WHERE fails = letter) AS BIGINT) AS unique_fails,
    CAST(sum(good) FILTER (WHERE NOT gone AND failing) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (WHERE NOT gone AND failing) AS BIGINT) AS toxic_lost
  FROM seen GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
  coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley
FROM counted"""


def _codes() -> str:
    """All rounds written out, one after the other."""
    assigned = """SELECT v.vec_id, v.row_id, v.p, v.x, arg_min(b.k, (s.s, b.k)) AS k, min(s.s) AS error
  FROM v JOIN {books} b ON b.p = v.p, LATERAL (SELECT CAST(list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS s) s GROUP BY 1, 2, 3, 4"""
    rounds = []
    for i in range(ROUNDS):
        rounds.append(f"a{i} AS MATERIALIZED ({assigned.format(books=f'b{i}')})")
        rounds.append(f"""m{i} AS (SELECT p, k, list(y ORDER BY j) AS x FROM (SELECT p, k, j, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS y FROM (SELECT p, k, unnest(x) AS y, unnest(range(len(x))) AS j FROM a{i}) e GROUP BY 1, 2, 3) g GROUP BY 1, 2)""")
        rounds.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.k = b.k)")
    return f"""WITH d AS (
  SELECT row_number() OVER () AS row_id, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT row_id, vec_id, p, x[(p * len(x) // {PARTS} + 1):((p + 1) * len(x) // {PARTS})] AS x FROM (SELECT *, unnest(range({PARTS})) AS p FROM d) u
), b0 AS MATERIALIZED (
  SELECT p, k, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id, row_id) - 1 AS k FROM v) n WHERE k < {ENTRIES}
), {", ".join(rounds)}, a AS MATERIALIZED ({assigned.format(books=f"b{ROUNDS}")}
), coded AS (
  SELECT row_id, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(error) AS BIGINT) AS error FROM a GROUP BY 1
)
SELECT d.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY d.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) FROM b{ROUNDS}) AS codebooks_sha256
FROM d JOIN coded c ON c.row_id = d.row_id"""


#: A word of a text is hit if a window starts at it or at one of the words before it within the window's length.
LEAKS = r"""WITH words AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:(i + least(10, len(w)) - 1)], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0) x
), sizes AS (
  SELECT DISTINCT m FROM windows
), starts AS (
  SELECT row_id, i, m, array_to_string(w[i:(i + m - 1)], ' ') AS k FROM (SELECT row_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words JOIN sizes ON len(w) >= m) x
), found AS MATERIALIZED (
  SELECT s.row_id, s.i, s.m, w.item_id FROM starts s JOIN windows w ON w.m = s.m AND w.k = s.k
), hit AS (
  SELECT row_id, count(DISTINCT i) AS n FROM (SELECT row_id, unnest(range(i, i + m)) AS i FROM (SELECT DISTINCT row_id, i, m FROM found) f) x GROUP BY 1
), listed AS (
  SELECT row_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) f GROUP BY 1
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, coalesce(listed.n, 0) AS n_items, sha256(coalesce(listed.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hit ON hit.row_id = words.row_id LEFT JOIN listed ON listed.row_id = words.row_id"""

ORACLE_SQL: dict[str, str] = {
    "op11_refinement_filter_audit": _audit(),
    "op12_tree_product_codes": _codes(),
    "op13_ngram_decontamination": LEAKS,
}
