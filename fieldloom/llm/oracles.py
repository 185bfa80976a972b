"""SQL of operators on texts: secrets, repeated strings, base formats of personal data, packing."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"


def _either_case(words: str) -> str:
    """ASCII letters in either case; a flag would fold other letters too."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in words)


#: kind, pattern, group that counts, its least length.
SECRET_RULES = (
    ("assign", rf"""({_either_case("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("url_login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", 0, 0),
)

PERSONAL_RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _matches(rank: int, kind: str, pattern: str, group: int = 0) -> str:
    """kind, start, end, whole and kept of each match: a match ends after all gaps before it and all matches up to it."""
    p = _quoted(pattern)
    return f"""SELECT row_id, {rank} AS rank, '{kind}' AS kind, whole, kept, sum(length(gap) + length(whole)) OVER (PARTITION BY row_id ORDER BY i) AS stop FROM (
  SELECT row_id, unnest(range(len(regexp_extract_all(text, '{p}')))) AS i, unnest(regexp_extract_all(text, '{p}')) AS whole, unnest(regexp_extract_all(text, '{p}', {group})) AS kept,
    unnest(string_split_regex(text, '{p}')[1:len(regexp_extract_all(text, '{p}'))]) AS gap FROM d WHERE regexp_matches(text, '{p}')
) m"""


_DOCS = "d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents)"

_LISTED = "string_agg(kind || ':' || (stop - length(whole))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY {order})"


def _secrets() -> str:
    every = "\nUNION ALL ".join(f"SELECT * FROM ({_matches(k, kind, p, g)}) x WHERE length(kept) >= {least}" for k, (kind, p, g, least) in enumerate(SECRET_RULES))
    order = "stop - length(whole), rank"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, *_ in SECRET_RULES[:3])
    return f"""WITH {_DOCS}, m AS ({every}), s AS (
  SELECT row_id, {counts}, {_LISTED.format(order=order)} FILTER (WHERE rank < 3) AS base, {_LISTED.format(order=order)} AS spans FROM m GROUP BY 1
) SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (row_id)"""


def _personal() -> str:
    """Base formats. Where contexts add spans, as they don't in random prose, the operator has more."""
    digits = "regexp_replace(whole, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN 1 ELSE 2 END * CAST(reverse({digits})[(i + 1)::INTEGER] AS INTEGER) - CASE WHEN i % 2 = 1 AND reverse({digits})[(i + 1)::INTEGER] >= '5' THEN 9 ELSE 0 END)) % 10 = 0"
    keep = {
        "email": "true",
        "ip": "len(list_filter(string_split(whole, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(p, 3) AS INTEGER) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }
    every = "\nUNION ALL ".join(f"SELECT * FROM ({_matches(k, kind, p)}) x WHERE {keep[kind]}" for k, (kind, p) in enumerate(PERSONAL_RULES))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, _ in PERSONAL_RULES)
    return f"""WITH {_DOCS}, m AS ({every}), s AS (SELECT row_id, {counts}, {_LISTED.format(order="rank, stop")} AS base FROM m GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, _ in PERSONAL_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(base, '') AS spans FROM d LEFT JOIN s USING (row_id)"""


#: All strings of 400 bytes by position, as hexadecimal digits.
SUBSTRINGS = """WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), strings AS (
  SELECT row_id, i, hash(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT row_id, h, unnest(range(n - 399)) AS i FROM d WHERE n >= 400) x
), twice AS (
  SELECT row_id, i FROM strings WHERE k IN (SELECT k FROM strings GROUP BY 1 HAVING count(*) > 1)
), marked AS (
  SELECT row_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY row_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens FROM twice
), runs AS (
  SELECT row_id, run, min(i) AS a, max(i) + 400 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY row_id ORDER BY i) AS run FROM marked) x GROUP BY 1, 2
), gaps AS (
  SELECT row_id, coalesce(lag(b) OVER (PARTITION BY row_id ORDER BY a), 0) AS a, a AS b FROM runs
  UNION ALL SELECT d.row_id, coalesce(max(r.b), 0), any_value(d.n) FROM d LEFT JOIN runs r ON r.row_id = d.row_id GROUP BY 1
), kept AS (
  SELECT g.row_id, string_agg(substr(d.h, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a) AS h FROM gaps g JOIN d ON d.row_id = g.row_id GROUP BY 1
), totals AS (
  SELECT row_id, sum(b - a) AS gone, count(*) AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS runs FROM runs GROUP BY 1
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(t.gone, 0) AS BIGINT) AS n_removed, coalesce(t.n, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256, coalesce(t.runs, '') AS removed
FROM d JOIN kept k ON k.row_id = d.row_id LEFT JOIN totals t ON t.row_id = d.row_id"""

#: Least padding with b buckets for the first j lengths: the last bucket holds the lengths after the i-th.
PACKING = rf"""WITH RECURSIVE d AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15) AS BIGINT) AS digest, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS n FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, digest) - 1 AS copy FROM d
), pieces AS (
  SELECT doc_id, digest, copy, n, unnest(range(greatest(0, (n - 1) // 2048) + 1)) AS piece FROM numbered
), sized AS (
  SELECT *, piece * 2048 AS start, greatest(0, least(2048, n - piece * 2048)) AS n_tokens,
    CAST('0x' || substr(md5(digest || ':' || copy || ':' || piece), 1, 15) AS BIGINT) AS place FROM pieces
), bins AS (
  SELECT n_tokens AS l, count(*) AS c, row_number() OVER (ORDER BY n_tokens) AS j FROM sized WHERE n_tokens > 0 GROUP BY 1
), sums AS MATERIALIZED (
  SELECT 0 AS j, 0 AS l, 0 AS c, 0 AS t UNION ALL SELECT j, l, sum(c) OVER (ORDER BY j), sum(c * l) OVER (ORDER BY j) FROM bins
), best(b, j, cost, i) AS (
  SELECT 1, j, CAST(l * c - t AS BIGINT), CAST(0 AS BIGINT) FROM sums WHERE j > 0
  UNION ALL
  SELECT b, j, min(cost), arg_min(i, (cost, i)) FROM (
    SELECT p.b + 1 AS b, s.j, p.j AS i, CAST(p.cost + s.l * (s.c - f.c) - (s.t - f.t) AS BIGINT) AS cost FROM best p JOIN sums f ON f.j = p.j JOIN sums s ON s.j > p.j
    UNION ALL
    SELECT (SELECT min(b) FROM best) + 1, s.j, 0, CAST(s.l * s.c - s.t AS BIGINT) FROM sums s WHERE s.j > 0
  ) x WHERE b <= least(16, (SELECT count(*) FROM bins)) GROUP BY b, j
), back(b, j) AS (
  SELECT min(b), any_value(j) FROM best WHERE j = (SELECT max(j) FROM bins) AND cost = (SELECT min(cost) FROM best WHERE j = (SELECT max(j) FROM bins))
  UNION ALL
  SELECT greatest(1, r.b - 1), p.i FROM back r JOIN best p ON p.b = r.b AND p.j = r.j WHERE p.i > 0
), bounds AS (
  SELECT s.l AS bound FROM back r JOIN sums s ON s.j = r.j
), placed AS (
  SELECT s.*, b.bound FROM sized s ASOF JOIN bounds b ON s.n_tokens <= b.bound WHERE s.n_tokens > 0
), counted AS (
  SELECT *, row_number() OVER (PARTITION BY bound ORDER BY place, doc_id, piece) - 1 AS p, greatest(1, 65536 // bound) AS room FROM placed
)
SELECT doc_id, piece, start, n_tokens, CAST(bound AS INTEGER) AS bucket_len, p // room AS batch, CAST(p % room AS INTEGER) AS slot, CAST(bound - n_tokens AS BIGINT) AS padding FROM counted
UNION ALL SELECT doc_id, piece, start, n_tokens, NULL, NULL, NULL, 0 FROM sized WHERE n_tokens = 0"""

ORACLE_SQL: dict[str, str] = {
    "op2_trigram_secrets": _secrets(),
    "op4_prefix_free_dedup": SUBSTRINGS,
    "op7_bootstrapped_pii": _personal(),
    "op8_length_buckets": PACKING,
}
