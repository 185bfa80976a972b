"""Personal data: base formats and bootstrapped contextual extraction.

One pass over the texts finds the base entities and, beside them, tokens that look like identifiers
without having a base format. Each comes with the lexical patterns around it: two words before, a word
on either side, or a label (a word that ends with a colon or the like). A second pass counts how often
each of these patterns stands around anything at all. Base entities are the seeds of a bipartite graph
of patterns and instances, which Spark scores in rounds: a pattern is as good as the share of its
places that hold known identifiers, where ordinary words count against it in full and unseen
identifiers a little; an instance is as good as its patterns together say. Instances found by trusted
patterns are new identifiers, and count for other patterns in the next round, until no pattern is new.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, cut, reused, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Up to so many patterns (8 bytes each) are sent to the executors, which then count only those; beyond, all are counted.
BROADCAST_PATTERNS = 2_000_000
#: The kind of the spans that contexts add.
CONTEXT = "context"

_LOCAL = r"[A-Za-z0-9._%+-]"
_EMAIL = re.compile(_LOCAL + r"+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Where a run starts. A run fits from any of its characters or from none, so the others needn't be tried.
_EMAIL_RUN = re.compile(rf"(?<!{_LOCAL})" + _EMAIL.pattern)
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_SPACES = re.compile(r"\s")
_WORD = re.compile(r"\S+")
#: What may stand around an identifier without being part of it.
_EDGE = ".,;:!?()[]{}<>\"'#$%&*|=`~"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := _EMAIL.match(text, at) or _EMAIL_RUN.search(text, at):
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), by kind, then start; leftmost and non-overlapping in each kind, failing matches dropped."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdecimal, m[0])) <= 15:
                    out.append((3, *m.span()))
    return out


def _shape(word: str) -> str:
    return _DIGIT.sub("0", word.lower().strip(_EDGE)) or word[:1]


#: The kinds of patterns: two words before, a word on either side, a label before.
_TWO, _ROUND, _LABEL = 0, 1, 2
#: What ends a label.
_LABELS = (":", "=", "#")
_ODD = 0x9E3779B97F4A7C15
_MASK = 2**64 - 1


def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _pattern(kind: int, a: int, b: int) -> int:
    """The pattern's number, a signed long, from the codes of its words."""
    x = ((a * _ODD + b) * _ODD + kind + 1) & _MASK
    return x - (1 << 64) if x >> 63 else x


class Around:
    """The words around spans of a text, as `places` has them: its words are those of str.split, of any length.

    Spans come in order of their starts; those in one word look for its neighbours once.
    """

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, 0, -1
        self.before: list[str] = []
        self.after: str | None = None

    def _back(self, at: int, n: int) -> list[str]:
        """The last n words before `at`, whole ones; fewer if there aren't as many."""
        reach = 64
        while True:
            start = max(0, at - reach)
            found = self.text[start:at].split()
            if start == 0 or len(found) > n:
                return found[-n:]
            reach *= 4

    def _word(self, at: int) -> tuple[int, int]:
        """Where the word at `at` begins and ends."""
        gap = _SPACES.search(self.text, at)
        tail = self._back(at, 1) if at and not self.text[at - 1].isspace() else [""]
        return at - len(tail[0]), gap.start() if gap else len(self.text)

    def patterns(self, start: int, end: int) -> list[int]:
        """The patterns around a span, each one of those around its words; a word on either side only of a span in one word."""
        if not self.begin <= start < self.end:
            self.begin, self.end = self._word(start)
            self.before = self._back(self.begin, 2)
            after = _WORD.search(self.text, self.end)
            self.after = after[0] if after else None
        before, out = self.before, []
        if len(before) == 2:
            out.append(_pattern(_TWO, _code(_shape(before[0])), _code(_shape(before[1]))))
        if before and end <= self.end and self.after:
            out.append(_pattern(_ROUND, _code(_shape(before[-1])), _code(_shape(self.after))))
        if before and before[-1].endswith(_LABELS):
            out.append(_pattern(_LABEL, _code(before[-1].lower()), 0))
        return out


class Codes:
    """Codes of words by their raw form, kept for those met lately."""

    def __init__(self, most: int = 1 << 18):
        self.most, self.known = most, {}

    def of(self, word: str) -> tuple[int, int]:
        """Of its shape, and of the word as a label (0 if it is none)."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[word] = (_code(_shape(word)), _code(word.lower()) if word.endswith(_LABELS) else 0)
        return found


def places(text: str, codes: Codes, step: int = 1 << 20) -> Iterator[np.ndarray]:
    """The patterns around every word of a text, whatever the word; a long text comes in parts that overlap by two words."""
    carried, at = [], 0
    while at < len(text):
        gap = _SPACES.search(text, at + step)
        end = gap.start() if gap else len(text)
        words = carried + text[at:end].split()
        at = end
        if not words:
            continue
        pairs = np.array([codes.of(w) for w in words], np.uint64)
        shape, label = pairs[:, 0], pairs[:, 1]
        odd, kind = np.uint64(_ODD), lambda k: np.uint64(k + 1)
        yield ((shape[:-2] * odd + shape[1:-1]) * odd + kind(_TWO)).view(np.int64)
        yield ((shape[:-2] * odd + shape[2:]) * odd + kind(_ROUND)).view(np.int64)
        # a label whose next word is not in this part yet counts with the next one
        named = label[1:-1] if len(carried) == 2 else label[:-1]
        yield (named[named > 0] * odd * odd + kind(_LABEL)).view(np.int64)
        carried = words[-2:]


def identifiers(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens with at least 5 digits, or 3 digits beside letters or @, that no base span touches."""
    out = []
    if not _DIGIT.search(text):
        return out
    taken = sorted((a, b) for _, a, b in taken)
    k = 0
    for m in _TOKEN.finditer(text):
        word = m[0]
        n = len(_DIGIT.findall(word))
        if n < 3:
            continue
        core = word.strip(_EDGE)
        if not core or (n < 5 and not any(c.isalpha() or c == "@" for c in core)):
            continue
        start = m.start() + word.index(core)
        end = start + len(core)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        out.append((start, end))
    return out


def _survey(rows: DataFrame) -> DataFrame:
    """doc_id, digest, counts of the base kinds, base (their spans as text), seen (what may be an identifier, with its patterns)."""
    seen = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            counts: list[list[int]] = [[], [], [], []]
            bases, found = [], []
            for text in batch.column(2).to_pylist():
                spans = base_spans(text)
                for k in range(4):
                    counts[k].append(sum(s[0] == k for s in spans))
                bases.append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans))
                both = sorted([(a, b, True) for _, a, b in spans] + [(a, b, False) for a, b in identifiers(text, spans)])
                around = Around(text)
                found.append([{"start": a, "end": b, "seed": s, "instance": text[a:b], "patterns": p} for a, b, s in both if (p := around.patterns(a, b))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(bases, pa.string()), pa.array(found, seen)], ["doc_id", "digest", *(f"n_{k}" for k in KINDS), "base", "seen"])

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id long, digest long, {kinds}, base string, seen array<struct<start:long,end:long,seed:boolean,instance:string,patterns:array<long>>>")


def _counted(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """pattern, places: how often each of the asked patterns stands around anything in the texts of rows."""
    n = asked.count()
    wanted = np.sort(asked.toArrow()["pattern"].to_numpy()) if n <= BROADCAST_PATTERNS else None
    sent = asked.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, wanted = Codes(), sent.value

        def summed(found: list[np.ndarray]) -> pa.RecordBatch:
            pattern, times = np.unique(np.concatenate(found), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(times.astype(np.int64))], ["pattern", "times"])

        found, kept = [], 0
        for batch in small_batches(batches):
            for text in batch.column(0).to_pylist():
                for x in places(text, codes):
                    if wanted is not None:
                        x = x[wanted[np.minimum(np.searchsorted(wanted, x), len(wanted) - 1)] == x] if len(wanted) else x[:0]
                    if len(x):
                        found.append(x)
                        kept += len(x)
                if kept >= 1 << 20:
                    yield summed(found)
                    found, kept = [], 0
        if found:
            yield summed(found)

    counts = rows.select("text").mapInArrow(run, "pattern long, times long").groupBy("pattern").agg(F.sum("times").alias("places"))
    return counts if wanted is not None else counts.join(asked, "pattern", "left_semi")


def bootstrap(edges: DataFrame, totals: DataFrame, confidence: float = 0.8, support: int = 3, unseen: float = 0.25, prior: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns (pattern, trust) and instances (instance, score).

    edges: distinct (pattern, instance, seed, times); totals: pattern, places. trust = known / (known +
    contradicted + unseen * unknown + prior): occurrences with known instances (counted with their
    scores), places without any identifier, occurrences with instances not known. A pattern trusts
    nothing below `confidence` or with fewer than `support` distinct known instances. Score of what is
    no seed = 1 - product of (1 - trust). Trust only grows from round to round, so the rounds end when
    no pattern is new.
    """
    edges = cut(edges.join(totals, "pattern").select("pattern", "instance", "seed", "times", "places"))
    seeds = edges.where("seed").select("instance", F.lit(1.0).alias("score")).distinct()
    scores = cut(seeds)
    before = -1
    while True:
        scored = edges.join(scores, "instance", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        sums = scored.groupBy("pattern").agg(F.sum(F.col("score") * F.col("times")).alias("known"), F.sum("times").alias("filled"), F.sum("score").alias("distinct"), F.max("places").alias("places"))
        against = F.greatest(F.lit(0), F.col("places") - F.col("filled")) + F.lit(unseen) * (F.col("filled") - F.col("known")) + F.lit(prior)
        patterns = cut(sums.withColumn("trust", F.col("known") / (F.col("known") + against)).where((F.col("distinct") >= support) & (F.col("trust") >= confidence)).select("pattern", "trust"))
        n = patterns.count()
        if n == before:
            return patterns, scores
        before = n
        told = edges.join(patterns, "pattern").groupBy("instance").agg(F.max("seed").alias("seed"), F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("trust")))).alias("doubt"))
        fresh = told.select("instance", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("doubt")).alias("score"))
        scores = cut(fresh.unionByName(seeds).groupBy("instance").agg(F.max("score").alias("score")))


def extract(docs: DataFrame, confidence: float = 0.8, support: int = 3) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs (doc_id, text).

    Spans are kind:start:end in code points (end exclusive), by kind, then start, comma-joined; spans
    that contexts add have the kind `context` and come last. Null texts are empty. Documents without id
    count like others; rows that repeat a document get its spans each. A pattern or an instance of any
    share of the rows is summed up in parts. Words around a span count whole, however long; they are counted
    in parts of a long text. The spans of one text are held together. No rows in, no rows out.
    """
    rows = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    survey = reused(_survey(rows))
    seen = survey.select("doc_id", "digest", F.explode("seen").alias("x")).select("doc_id", "digest", "x.*")
    edges = seen.select(F.explode("patterns").alias("pattern"), F.xxhash64("instance").alias("instance"), "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("times"))
    several = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("pattern")
    asked = cut(several)
    patterns, scores = bootstrap(edges.join(asked, "pattern"), _counted(rows, asked), confidence, support)
    new = seen.where("not seed").select("doc_id", "digest", "start", "end", F.xxhash64("instance").alias("instance"), F.explode("patterns").alias("pattern"))
    new = new.join(patterns, "pattern").join(scores.where(F.col("score") >= confidence), "instance")
    added = new.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("added")).withColumnRenamed("doc_id", "doc").withColumnRenamed("digest", "text_digest")
    added = cut(added)
    out = survey.join(added, survey["doc_id"].eqNullSafe(added["doc"]) & (survey["digest"] == added["text_digest"]), "left")
    more = F.concat_ws(",", F.transform("added", lambda x: F.concat_ws(":", F.lit(CONTEXT), x["start"].cast("string"), x["end"].cast("string"))))
    some = F.when(F.col("added").isNull(), F.col("base")).when(F.col("base") == "", more).otherwise(F.concat_ws(",", "base", more))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), some.alias("spans"))
