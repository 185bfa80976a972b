"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression. Its Boolean trigram query (see trigrams.py) names the trigrams that
any match must contain. The index holds postings (trigram, doc_id) for the trigrams that some rule
asks for; intersecting and uniting them by the query gives each rule's candidate documents, and only
there the expression runs. Rules without mandatory trigrams run over every document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, reused
from .trigrams import Query, compile_query


#: Entries folded at once in running sums; code points of a chunk of a text that is masked.
BLOCK, CHUNK = 128, 1024
#: Up to so many candidates (an id and the names of a few rules each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_CANDIDATES = 500_000


@dataclass(frozen=True)
class Rule:
    """pattern: for Java and Python alike; matches whose `group` has fewer than `least` characters are dropped, not retried."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The kinds that the contract names, in its order. A run of [0-9a-f]+ with 32 or more characters is written as {32,}: shorter runs never match.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+"),
)

#: Formats of widely used keys, published by those who issue them.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)


def build_index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Postings: (trigram, doc_id) for each of the given trigrams (lower case) and each document whose lower-cased text has it."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    rows = columns_of(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    has = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(t)), F.lit(t)) for t in sorted(trigrams)]))
    return rows.select("doc_id", F.explode(has).alias("trigram"))


def _holds(query: Query, found: Column) -> Column:
    if query.kind == "tri":
        return F.array_contains(found, query.tri)
    parts = [_holds(x, found) for x in sorted(query.parts, key=str)]
    out = parts[0]
    for x in parts[1:]:
        out = (out & x) if query.kind == "and" else (out | x)
    return out


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """doc_id, kinds: the rules whose trigram query a document's postings fulfil. At most one entry a trigram is held for a document."""
    by_doc = postings.groupBy("doc_id").agg(F.collect_set("trigram").alias("found"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("found")), F.lit(k)) for k, q in queries.items()]))
    return by_doc.select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is made once, however often the body names it (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def _blocks(values: Column, fold: Callable[[Column], Column]) -> Column:
    """fold of each BLOCK values that follow each other."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: fold(F.slice(values, k * BLOCK + 1, F.lit(BLOCK))))


def _running(values: Column, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """Running folds of an array of numbers (of none: none). Three levels of blocks bound the work an entry by a few blocks' length, up to BLOCK^3 entries."""

    def level(values: Column, above: Column | None) -> Column:
        """Running folds, those of the blocks before coming from above."""

        def one(i: Column) -> Column:
            start = F.floor(i / BLOCK).cast("int")
            own = fold(F.slice(values, start * BLOCK + 1, i - start * BLOCK + 1))
            return own if above is None else F.when(start == 0, own).otherwise(join(F.get(above, start - 1), own))

        return F.transform(F.sequence(F.lit(0), F.size(values) - 1), one)

    def whole(values: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: fold(F.slice(values, F.lit(1), i + 1)))
        few = F.size(values) <= BLOCK
        blocks = lambda b: _let(_blocks(b, fold), lambda c: _let(F.transform(F.sequence(F.lit(0), F.size(c) - 1), lambda i: fold(F.slice(c, F.lit(1), i + 1))), lambda c: level(b, c)))
        return F.when(F.size(values) == 0, values).when(few, every).otherwise(_let(_blocks(values, fold), lambda b: _let(blocks(b), lambda b: level(values, b))))

    return whole(values)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def spans_of(rule: Rule, rank: int, text: Column) -> Column:
    """array<struct<start, rank, end, kind>> of the rule's matches, leftmost and non-overlapping, in code points.

    The text is split at the matches, so a match starts after all gaps up to it and all matches before it.
    """
    pattern = F.lit(rule.pattern)
    lengths = lambda found: F.transform(found, lambda x: F.length(x).cast("long"))
    whole = lengths(F.regexp_extract_all(text, pattern, F.lit(0)))
    group = lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))) if rule.group else None

    def placed(whole: Column) -> Column:
        gaps = lengths(F.split(text, rule.pattern, -1))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, m: g + m)
        ends = _let(steps, lambda x: _running(x, _total, lambda a, b: a + b))
        rows = F.arrays_zip(ends.alias("end"), whole.alias("whole"), (whole if group is None else group).alias("kept"))
        rows = F.filter(rows, lambda x: x["kept"] >= rule.least)
        return F.transform(rows, lambda x: F.struct((x["end"] - x["whole"]).alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")))

    return _let(whole, placed)


NO_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def find(docs: DataFrame, rules: Sequence[Rule] = (*BASE_RULES, *MORE_RULES)) -> DataFrame:
    """The rows of docs as `row` (a struct of all their columns), their text (null: empty) and `spans`, sorted by start, then rule.

    docs: doc_id, text and any other columns. Rows that repeat an id are each judged on their own text.
    Documents without id are verified whenever one of them is a candidate. The work on a very long text
    grows in proportion to its length and its spans; a text's spans are held together. Matches of one
    rule never overlap; of matches that start together the rule listed first comes first. No rows in,
    no rows out.
    """
    queries = {r.kind: compile_query(r.pattern) for r in rules}
    asked = {k: q for k, q in queries.items() if q.kind != "any"}
    vocabulary = set().union(*(q.trigrams() for q in asked.values()))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), text.alias("text"))
    if asked:
        few = reused(candidates(build_index(docs, sorted(vocabulary)), asked).withColumnRenamed("doc_id", "candidate"))
        # candidates are a few in a hundred documents; while they are few in number too, no text needs to move
        few = F.broadcast(few) if few.count() <= BROADCAST_CANDIDATES else few
        rows = rows.join(few, rows["doc_id"].eqNullSafe(few["candidate"]), "left")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast(NO_SPANS)
    found = []
    for rank, rule in enumerate(rules):
        look = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) if rule.kind in asked else F.col("text").rlike(rule.pattern)
        found.append(F.when(look, spans_of(rule, rank, F.col("text"))).otherwise(none))
    return rows.select("row", "doc_id", "text", F.array_sort(F.concat(*found)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def scan(docs: DataFrame, rules: Sequence[Rule] = (*BASE_RULES, *MORE_RULES)) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined) for each row of docs."""
    found = find(docs, rules)
    base = F.filter("spans", lambda x: x["rank"] < len(BASE_RULES))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _piece(chunks: Column, start: Column, end: Column) -> Column:
    """The text from start to end, which is cut into chunks, so that its middle is reached without reading from its start."""
    a, b = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    at = (start - a * CHUNK).cast("int") + 1
    first = F.get(chunks, a)
    several = F.concat(F.substring(first, at, F.lit(CHUNK)), F.array_join(F.slice(chunks, a + 2, b - a - 1), ""), F.substring(F.get(chunks, b), F.lit(1), (end - b * CHUNK).cast("int")))
    return F.when(start >= end, F.lit("")).when(a == b, F.substring(first, at, (end - start).cast("int"))).otherwise(several)


def _masked(chunks: Column, spans: Column, mark: str) -> Column:
    """The text with each stretch covered by spans replaced; spans are in order of their starts, and one that begins inside what is masked already only lengthens the stretch."""

    def joined(reach: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(reach, i - 1))
        gaps = F.transform(spans, lambda x, i: F.when((i == 0) | (x["start"] >= before(i)), _piece(chunks, before(i), x["start"])))
        size = (F.size(chunks) - 1) * CHUNK + F.length(F.get(chunks, F.size(chunks) - 1))
        return F.array_join(F.concat(F.array_compact(gaps), F.array(_piece(chunks, F.get(reach, F.size(reach) - 1), size.cast("long")))), mark)

    reach = _let(F.transform(spans, lambda x: x["end"]), lambda ends: _running(ends, F.array_max, F.greatest))
    return _let(reach, joined)


def redact(docs: DataFrame, rules: Sequence[Rule] = (*BASE_RULES, *MORE_RULES), mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with every stretch of text that spans cover replaced by `mark`; other columns and rows stay. Null texts stay null."""
    found = find(docs, rules)
    masked = _let(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0)), lambda chunks: _masked(chunks, F.col("spans"), mark))
    found = found.withColumn("masked", F.when(F.size("spans") > 0, masked))
    columns = [F.coalesce("masked", F.col("row")["text"]).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        columns[docs.columns.index("n_chars")] = F.when(F.col("masked").isNotNull(), F.length("masked").cast("long")).otherwise(F.col("row")["n_chars"]).alias("n_chars")
    return found.select(*columns)
