"""Removal of long repeated substrings with prefix-free parsing and suffix arrays.

1. Parse. Every position at which a string of `length` bytes starts belongs to one trigger: the window
   with the least rolling hash among those that start in the next `span` positions. Two equal strings
   have their triggers at the same place in them, so they share the bytes that follow the trigger for
   length - span + 1 bytes (the core). Positions of one trigger are a range, and come as one row.
2. Filter. Ranges whose core occurs once hold no repeated string. Ranges whose whole context (all
   strings of the range) occurs again are repeated throughout. Both are told by partially aggregated
   counts over digests.
3. Order. What is left, ranges in which only some strings are repeated, comes together by core, one
   copy of each distinct context. There the contexts are parsed into phrases; the suffix arrays of
   dictionary and parse give the order of all positions, in which equal strings are neighbours.
   Cores with more than `group` distinct contexts are not brought together: their contexts are parsed
   again with a narrower span, whose cores are longer and divide them, and go through steps 2 and 3. At a
   span of one position the core is the whole string, so contexts of one core are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .common import byte_texts, columns_of, freed, may_be_among, parallelism, reused, small_batches
from .parsing import PIECE, Parse, Rolling, anchors

#: A range is kept as one number, its first position times WIDE and its width (less 1).
WIDE = 512
#: Bits of the digests of core and context that are kept; together they tell contexts apart.
CORE_BITS, CONTEXT_BITS = 48, 56
#: Bytes of a trigger, and the positions among which one is chosen.
TRIGGER, SPAN = 16, 320
#: How many times narrower the span of crowded cores becomes.
NARROWER = 8
#: Bytes of contexts ordered at once.
ORDERED = 1 << 19


@lru_cache(maxsize=4)
def rolling(seed: int) -> Rolling:
    return Rolling(seed)


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text's number, where the piece starts, bytes), in lots of about PIECE bytes. Pieces of a text overlap, so that each string is in one of them."""
    lot, held = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            piece = text[at : at + PIECE + length - 1]
            if len(piece) < length:
                continue
            lot.append((k, at, piece))
            held += len(piece)
            if held >= PIECE:
                yield lot
                lot, held = [], 0
    if lot:
        yield lot


def ranges(texts: list[bytes], length: int, span: int) -> Iterator[dict[str, np.ndarray]]:
    """text, low, high (first and last position of the range), core, context; for all positions at which `length` bytes start."""
    one, two = rolling(1), rolling(2)
    for lot in _pieces(texts, length):
        data = np.frombuffer(b"".join(x for _, _, x in lot), np.uint8)
        sizes = np.array([len(x) for _, _, x in lot])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        sums = one.sums(data)
        trigger = anchors(one.windows(sums, TRIGGER), span)
        n = sizes - length + 1
        piece = np.repeat(np.arange(len(lot)), n)
        position = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
        at = trigger[position]
        fresh = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])]))
        low, high = position[fresh], position[np.concatenate([fresh[1:], [len(position)]]) - 1]
        at, piece = at[fresh], piece[fresh]
        offset = np.array([x for _, x, _ in lot])[piece] - starts[piece]
        yield {
            "text": np.array([x for x, _, _ in lot])[piece],
            "low": low + offset,
            "high": high + offset,
            "core": one.of(sums, at, at + length - span + 1).view(np.int64),
            "context": two.of(two.sums(data), low, high + length).view(np.int64),
        }


def _parsed(texts: DataFrame, length: int, span: int) -> DataFrame:
    """key, at (the range, in the document), own, core, context. texts: key, base (where in its document the text starts), own, text."""
    if span > WIDE:
        raise ValueError(f"span must not exceed {WIDE}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            base = np.asarray(batch.column(1))
            for x in ranges(byte_texts(batch.column(3)), length, span):
                at = (x["low"] + base[x["text"]]) * WIDE + x["high"] - x["low"]
                digests = [x["core"].view(np.uint64) >> np.uint64(64 - CORE_BITS), x["context"].view(np.uint64) >> np.uint64(64 - CONTEXT_BITS)]
                text = pa.array(x["text"])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(text), pa.array(at), batch.column(2).take(text), *(pa.array(d.view(np.int64)) for d in digests)], ["key", "at", "own", "core", "context"])

    return texts.select("key", "base", "own", "text").mapInArrow(run, "key long, at long, own boolean, core long, context long")


def _contexts(asked: DataFrame, length: int) -> DataFrame:
    """core, key, low, width, own, bytes: the asked contexts with their bytes. asked: key, text and asked (their places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            out: list[tuple] = []
            for key, text, places in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for p in places:
                    low, width = divmod(p["at"], WIDE)
                    out.append((p["core"], key, low, width, p["own"], text[low : low + width + length]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["core", "key", "low", "width", "own", "bytes"])

    return asked.select("key", "text", "asked").mapInArrow(run, "core long, key long, low long, width int, own boolean, bytes binary")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


def repeated_ranges(contexts: list[bytes], owned: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(context's number, first, last position) of the stretches of owned positions whose strings occur twice among all contexts."""
    parse = Parse(contexts, rolling(3))
    number = np.repeat(np.arange(len(contexts)), owned)
    inside = np.arange(int(owned.sum())) - np.repeat(np.cumsum(owned) - owned, owned)
    flags = parse.repeated(parse.starts[number] + inside, length)
    bounds = np.cumsum(owned)
    # stretches end where a context ends
    first, last = _runs(flags)
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        while a <= b:
            k = int(number[a])
            e = min(b, int(bounds[k]) - 1)
            yield k, int(inside[a]), int(inside[e])
            a = e + 1


def _ordered(contexts: DataFrame, length: int) -> DataFrame:
    """key, low, high: stretches of repeated strings among contexts that are together by core."""

    def work(x: pd.DataFrame) -> pd.DataFrame:
        x = x.drop_duplicates(["core", "key", "low"], ignore_index=True)
        found = list(repeated_ranges(x["bytes"].tolist(), x["width"].to_numpy() + 1, length))
        at, a, b = (np.array(c, np.int64) for c in (zip(*found, strict=True) if found else ((), (), ())))
        x = x.iloc[at]
        low = x["low"].to_numpy()
        return pd.DataFrame({"key": x["key"].to_numpy(), "low": low + a, "high": low + b})[x["own"].to_numpy(bool)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for x in frames:
            x = x if rest is None else pd.concat([rest, x], ignore_index=True)
            core, held = x["core"].to_numpy(), x["bytes"].map(len).cumsum().to_numpy()
            ends = np.flatnonzero(core[1:] != core[:-1]) + 1  # where a core's contexts are complete
            begun = 0
            while len(ends) and (held[-1] - (held[begun - 1] if begun else 0)) >= ORDERED:
                enough = held[ends - 1] - (held[begun - 1] if begun else 0) >= ORDERED
                end = int(ends[enough.argmax()] if enough.any() else ends[-1])
                yield work(x.iloc[begun:end])
                begun, ends = end, ends[ends > end]
            rest = x.iloc[begun:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield work(rest)

    return contexts.mapInPandas(run, "key long, low long, high long")


def _settled(texts: DataFrame, rows: DataFrame, length: int, span: int, group: int) -> tuple[DataFrame, DataFrame | None]:
    """key, low, high of repeated strings, and the contexts of crowded cores as texts for a narrower span, if there are any.

    texts: as in _parsed; where a text isn't own, its strings are only there to be met by others. rows: key, text.
    """
    parts = parallelism(rows.sparkSession)
    parsed = reused(_parsed(texts, length, span))
    # held, so that both sides of the joins with it are plain exchanges, whose skewed partitions Spark can split
    cores = reused(parsed.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"))
    # dealt anew by document, so that no file holds a core's rows alone and what is skewed can be split later
    again = reused(parsed.join(cores, "core").repartition(parts, "key", "at"))
    again.count()
    freed(parsed, cores)
    contexts = reused(again.groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at")).alias("first"), F.min("own").alias("own")))
    often = contexts.where("n > 1").select("core", "context")
    low, width = F.floor(F.col("at") / WIDE), F.col("at") % WIDE
    whole = again.where("own").join(often, ["core", "context"]).select("key", low.alias("low"), (low + width).alias("high"))
    open_ = (F.col("n") == 1) & F.col("own")
    mixed = contexts.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.max(open_).alias("open")).where("kinds > 1 and open")
    mixed = reused(mixed.select("core", (F.lit(span > 1) & (F.col("kinds") > group)).alias("crowded")))
    asked = contexts.join(mixed, "core").select("core", "crowded", "first.*", open_.alias("own"))
    by_doc = reused(asked.groupBy("key", "crowded").agg(F.collect_list(F.struct("core", "at", "own")).alias("asked")))
    held = rows.where(may_be_among(by_doc.select("key"))).join(by_doc, "key")
    found = whole.unionByName(_ordered(_contexts(held.where("not crowded"), length).repartition(parts, "core").sortWithinPartitions("core"), length))
    if not mixed.where("crowded").limit(1).count():
        return found, None
    # cut, since a plan over all levels would grow by a factor with each
    return found, cut(_contexts(held.where("crowded"), length).select("key", F.col("low").alias("base"), "own", F.col("bytes").alias("text")))


def repeated(rows: DataFrame, length: int = 400, span: int = SPAN, group: int = 4096) -> DataFrame:
    """key, spans (low, high): where strings of `length` bytes start that start elsewhere too, for documents that have some.

    rows: key (which tells them apart), doc_id, text.
    """
    rows = rows.where(F.octet_length("text") >= length).select("key", "text")
    found, texts = _settled(rows.select("key", F.lit(0).cast("long").alias("base"), F.lit(True).alias("own"), "text"), rows, length, span, group)
    while texts is not None:
        span = max(1, span // NARROWER)
        more, texts = _settled(texts, rows, length, span, group)
        found = found.unionByName(more)
    return found.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with key, a digest of id and text; another seed is taken if two different rows had one key."""
    for seed in range(8):
        keyed = rows.select(F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"), "doc_id", "text")
        other = F.xxhash64(F.lit(seed + 100), "text", "doc_id")
        shared = keyed.select("key", other.alias("other")).groupBy("key").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b")
        if not shared.limit(1).count():
            return keyed
    raise RuntimeError("no seed tells the rows apart")


def removed(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end exclusive) of bytes covered by strings that start within the spans."""
    out: list[tuple[int, int]] = []
    for low, high in sorted({(x["low"], x["high"]) for x in spans}):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high + length))
        else:
            out.append((low, high + length))
    return out


def deduplicate(docs: DataFrame, length: int = 400, span: int = SPAN, group: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (runs start:end in bytes, comma-joined), one row per row of docs.

    docs: doc_id, text. Texts are UTF-8 bytes, null ones empty. A byte goes if a string of `length`
    bytes that covers it also starts anywhere else; strings don't reach over the end of a text, and are
    judged on the input. Rows that repeat a document repeat its strings. What stays may not be valid
    UTF-8. No rows in, no rows out.
    """
    rows = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _keyed(rows)
    joined = rows.join(repeated(rows, length, span, group), "key", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = []
            for text, spans in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                gone = removed(spans or [], length)
                keep, at = hashlib.sha256(), 0
                for a, b in gone:
                    keep.update(text[at:a])
                    at = b
                keep.update(text[at:])
                out.append((len(text), sum(b - a for a, b in gone), len(gone), keep.hexdigest(), ",".join(f"{a}:{b}" for a, b in gone)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed string")
