"""Benchmark passages in training documents: found, counted and removed.

The windows of the benchmark (ten words in a row, normalised; fewer where an item has fewer) are a hash set
that is sent to the executors. Documents are scanned there: the words of a few hundred texts are laid out as
one line, the hash of every window is a difference of prefix sums, and a table of bits decides which windows
are looked up. What has the hash of a benchmark window is compared word by word. No text moves.

The set is sent in as many portions as its bytes ask for, so an executor never holds more than one bounded
portion; what the portions find in a document is put together by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, columns_of, cut, may_be_among, reused
from .simhash import keys

WINDOW = 10
#: Bytes of windows that are sent at once.
PORTION = 1 << 26
#: Bytes of texts that are laid out together; a longer text is read in stretches of as many.
STEP = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _alphabet() -> bytes:
    """Every byte as the contract reads it: A-Z as a-z; other ASCII that is no digit or letter as a space."""
    word = lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if word(b) else 0x20 for b in range(256))


_READ = _alphabet()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_READ).split()


def windows_of(text: bytes, size: int = WINDOW) -> set[bytes]:
    """The windows of a benchmark item, words joined by spaces."""
    words = words_of(text)
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as a line has bytes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            factors = np.full((2, 1 << n.bit_length()), [[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
            factors[:, 0] = 1
            self.up, self.down = np.cumprod(factors, axis=1, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = _Powers()


class Line:
    """Normalised words in a row: where each starts and ends in the line and in the source, and prefix sums of the bytes."""

    def __init__(self, source: bytes):
        read = np.frombuffer(source.translate(_READ), np.uint8)
        inside = read != 0x20
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        self.begin, self.end = edges[::2], edges[1::2]  # in the source
        inside[self.end[self.end < len(read)]] = True  # one space after each word
        self.text = read[inside]
        self.stop = np.cumsum(self.end - self.begin + 1) - 1
        self.start = self.stop - (self.end - self.begin)

    def __len__(self) -> int:
        return len(self.begin)

    @cached_property
    def _sums(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * _powers.of(len(self.text) + 1)[0][:-1])])

    def hashes(self, size: int) -> np.ndarray:
        """Of the windows of so many words, one for each word that such a window starts at."""
        if len(self) < size:
            return np.empty(0, np.uint64)
        first, last = self.start[: len(self) - size + 1], self.stop[size - 1 :]
        with np.errstate(over="ignore"):
            return (self._sums[last] - self._sums[first]) * _powers.of(len(self.text) + 1)[1][first] * _MIX

    def window(self, at: int, size: int) -> bytes:
        return self.text[self.start[at] : self.stop[at + size - 1]].tobytes()


@dataclass
class Lookup:
    """Windows of one number of words: ascending hashes, the windows of each, and bits of the hashes that occur."""

    size: int
    hashes: np.ndarray
    windows: dict[int, dict[bytes, list[str]]]

    @cached_property
    def _bits(self) -> tuple[np.ndarray, np.uint64]:
        width = min(24, max(10, (16 * len(self.hashes)).bit_length()))
        shift = np.uint64(64 - width)
        table = np.zeros(1 << width, bool)
        table[(self.hashes >> shift).astype(np.int64)] = True
        return table, shift

    def found(self, line: Line) -> Iterator[tuple[int, list[str]]]:
        """(word, items of the window that starts there)."""
        h = line.hashes(self.size)
        table, shift = self._bits
        some = np.flatnonzero(table[(h >> shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
        for i in some[self.hashes[at] == h[some]].tolist():
            items = self.windows[int(h[i])].get(line.window(i, self.size))
            if items is not None:
                yield i, items


def lookups(windows: list[tuple[bytes, list[str]]]) -> list[Lookup]:
    """By number of words, the greatest first."""
    by_size: dict[int, dict[int, dict[bytes, list[str]]]] = {}
    for window, items in windows:
        line = Line(window)
        by_size.setdefault(len(line), {}).setdefault(int(line.hashes(len(line))[0]), {})[window] = items
    return [Lookup(n, np.sort(np.fromiter(x, np.uint64, len(x))), x) for n, x in sorted(by_size.items(), reverse=True)]


_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _pieces(text: bytes, step: int) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of about `step`, cut where no word is."""
    at = 0
    while at < len(text):
        gap = _BREAK.search(text, at + step)
        end = gap.start() if gap else len(text)
        yield at, end
        at = end


class Scan:
    """What is found in one document."""

    def __init__(self) -> None:
        self.words = self.hit = 0
        self.spans: list[list[int]] = []  # byte ranges of maximal runs of words hit
        self.items: set[str] = set()
        self._last = -2  # the last word hit

    def add(self, flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """The next words: whether each is hit, and its bytes."""
        for i in np.flatnonzero(flags).tolist():
            if self.words + i == self._last + 1:
                self.spans[-1][1] = int(end[i])
            else:
                self.spans.append([int(begin[i]), int(end[i])])
            self._last = self.words + i
            self.hit += 1
        self.words += len(flags)


def _flags(line: Line, owner: np.ndarray, sets: list[Lookup], scans: list[Scan]) -> np.ndarray:
    """Which words of the line are hit, by windows of words of one owner; what is found goes to the owner's scan."""
    hit = np.zeros(len(line) + 1, np.int64)
    for lookup in sets:
        for i, items in lookup.found(line):
            if owner[i] == owner[i + lookup.size - 1]:
                hit[i] += 1
                hit[i + lookup.size] -= 1
                scans[owner[i]].items.update(items)
    return np.cumsum(hit[:-1]) > 0


def _scan_short(texts: list[bytes], sets: list[Lookup]) -> list[Scan]:
    """Texts laid out as one line."""
    line = Line(b"\n".join(texts))
    ends = np.cumsum([len(x) + 1 for x in texts])
    owner = np.searchsorted(ends, line.begin, side="right")
    scans = [Scan() for _ in texts]
    flags = _flags(line, owner, sets, scans)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k, scan in enumerate(scans):
        own, offset = slice(at[k], at[k + 1]), ends[k] - len(texts[k]) - 1
        scan.add(flags[own], line.begin[own] - offset, line.end[own] - offset)
    return scans


def _scan_long(text: bytes, sets: list[Lookup], step: int, lap: int) -> Scan:
    """A text in stretches; the last `lap` words of one are read again with the next, and settled there."""
    scan, begin, known = Scan(), 0, np.zeros(0, bool)
    for _, end in _pieces(text, step):
        line = Line(text[begin:end])
        flags = _flags(line, np.zeros(len(line), np.int64), sets, [scan])
        flags[: len(known)] |= known
        settled = len(line) if end == len(text) else max(0, len(line) - lap)
        scan.add(flags[:settled], line.begin[:settled] + begin, line.end[:settled] + begin)
        known = flags[settled:]
        begin = begin + int(line.begin[settled]) if settled < len(line) else end
    return scan


def scanned(texts: list[bytes], sets: list[Lookup], step: int = STEP) -> list[Scan]:
    """Each text scanned for the windows of the sets."""
    lap = max((s.size for s in sets), default=1) - 1
    scans: list[Scan | None] = [None] * len(texts)
    held: list[int] = []

    def laid_out() -> None:
        for k, scan in zip(held, _scan_short([texts[k] for k in held], sets), strict=True):
            scans[k] = scan
        held.clear()

    for k, text in enumerate(texts):
        if len(text) > step:
            scans[k] = _scan_long(text, sets, step, lap)
            continue
        held.append(k)
        if sum(len(texts[j]) for j in held) >= step:
            laid_out()
    if held:
        laid_out()
    return scans


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """key (of the window's portion), window, items (ids as strings, ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                found = sorted(windows_of(text, size))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], ["item", "window"])

    rows = columns_of(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(run, "item string, window binary").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _one_pass(rows: DataFrame, sets: list[Lookup], step: int, found_only: bool) -> DataFrame:
    """doc_id, key, check, n_words, n_hit, items, spans of each row (doc_id, key, check, text), or of those that have any."""
    sent = rows.sparkSession.sparkContext.broadcast(sets)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                scans = scanned(byte_texts(batch.column(3)), sent.value, step)
                columns = [pa.array([s.words for s in scans], pa.int64()), pa.array([s.hit for s in scans], pa.int64()), pa.array([sorted(s.items) for s in scans], pa.list_(pa.string())), pa.array([[{"start": a, "end": b} for a, b in s.spans] for s in scans], span)]
                out = pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "key", "check", "n_words", "n_hit", "items", "spans"])
                yield out.filter(pa.array([s.hit > 0 for s in scans])) if found_only else out

    return rows.mapInArrow(run, "doc_id long, key long, check long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")


def _together(rows: DataFrame, portions: Iterator[list[Lookup]], step: int) -> DataFrame:
    """What several portions of the set find, one after the other, put together by document."""
    found = None
    for sets in portions:
        part = cut(_one_pass(rows, sets, step, True))
        found = found.unionByName(part) if found is not None else part
    # rows that repeat a document find the same
    found = found.distinct().groupBy("key", "check").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                hits, spans = [], []
                for text, every in zip(byte_texts(batch.column(3)), batch.column(5).to_pylist(), strict=True):
                    n, joined = _covered(text, [(s["start"], s["end"]) for s in every or ()])
                    hits.append(n)
                    spans.append([{"start": a, "end": b} for a, b in joined])
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                words = pa.array([sum(len(Line(x[a:b])) for a, b in _pieces(x, step)) for x in byte_texts(batch.column(3))], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], words, pa.array(hits, pa.int64()), batch.column(4), pa.array(spans, kinds)], ["doc_id", "key", "check", "n_words", "n_hit", "items", "spans"])

    out = rows.join(found, ["key", "check"], "left").select("doc_id", "key", "check", "text", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")
    return out.mapInArrow(run, "doc_id long, key long, check long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")


def _covered(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """(words in the spans, their maximal runs): spans that overlap, or between which no word stands, become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and (a <= out[-1][1] or not words_of(text[out[-1][1] : a])):
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return sum(len(words_of(text[a:b])) for a, b in out), [(a, b) for a, b in out]


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, portion: int = PORTION, step: int = STEP) -> DataFrame:
    """doc_id, key, check, n_words, n_hit, items, spans for each row of docs (doc_id, text).

    benchmark: item_id, text. A document word inside any occurrence of an item's window is hit; items are the ids
    (as strings, ascending) of those with windows that occur; spans are the bytes, end exclusive, of the maximal runs
    of words hit. Null texts have no words; items without words have no window. Rows that repeat an item_id are one
    item; windows of items without an id hit, but aren't listed. Other columns don't matter. Texts of any length are
    read in stretches. No documents in, no rows out; no benchmark, no hits.
    """
    rows = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), *keys(), "text")
    windows = cut(_windows(benchmark, size))
    cost = F.length("window") + 8 + F.coalesce(F.aggregate("items", F.lit(0), lambda n, x: n + F.length(x) + 8), F.lit(0))
    portions = max(1, -(-int(windows.agg(F.sum(cost)).first()[0] or 0) // portion))

    def sets() -> Iterator[list[Lookup]]:
        for k in range(portions):
            some = windows.where(F.pmod(F.xxhash64("window"), F.lit(portions)) == k)
            yield lookups([(bytes(r["window"]), r["items"]) for r in some.toLocalIterator()])

    return _together(rows, sets(), step) if portions > 1 else _one_pass(rows, next(sets()), step, False)


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", size: int = WINDOW) -> DataFrame:
    """docs without the spans of benchmark words (remove="spans"), or without the documents that have any ("documents").

    All columns stay; rows that aren't hit go through as they are, without a shuffle.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"unknown remove {remove!r}")
    hit = reused(scan(docs, benchmark, size).where("n_hit > 0").select("key", "check", "spans").dropDuplicates(["key", "check"]))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).select("row", *keys(), "text")
    doubtful = may_be_among(hit.select("key"))
    plain, some = rows.where(~doubtful).select("row.*"), rows.where(doubtful)
    if remove == "documents":
        return plain.unionByName(some.join(hit, ["key", "check"], "left_anti").select("row.*"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if spans:
                    raw, at, parts = text.encode(), 0, []
                    for s in spans:
                        parts.append(raw[at : s["start"]])
                        at = s["end"]
                    text = b"".join([*parts, raw[at:]]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])

    fields = some.join(hit.select("key", "check", "spans"), ["key", "check"], "left").select("row", "text", "spans")
    kind = fields.schema["row"].dataType.simpleString()
    done = fields.mapInArrow(run, f"row {kind}, text string").withColumn("row", F.col("row").withField("text", F.col("text"))).select("row.*")
    return plain.unionByName(done)

