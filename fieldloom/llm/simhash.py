"""SimHash near-dedup by anchor-point covering.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 2 bits of their low half or
in at most 1 bit of their high half. Each half is covered by a code: the [31, 26] Hamming code on 31
bits, the last bit taken as it is, which has covering radius 1. Its words are the anchors. Every
fingerprint is replicated to all anchors of a half within that radius plus the half's threshold, one
of them being its home (the nearest). If two fingerprints agree in a half up to its threshold, the
home of each is within radius plus threshold of the other, so per anchor the homes are compared with
all replicas there. Replicas per fingerprint are a constant (about 172 and 17), the anchors number
2^27 a half, so the work follows the number of distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, columns_of, cut, may_be_among, parallelism, reused, small_batches, stretches
from .components import components, local_forests

RADIUS = 1
#: Differing bits looked for in the low and the high half: 2 + 1 + (2 - 1) makes up 4.
HALF_THRESHOLDS = (2, 1)
THRESHOLD = sum(x + 1 for x in HALF_THRESHOLDS) - 1


def fingerprint(text: bytes, words_per_shingle: int = 4, seed: int = 42, step: int = 1 << 20) -> int:
    """The fingerprint of one text. Its words are made and hashed in stretches of about `step` bytes, so a long text's words are never held together."""
    k, n, held = words_per_shingle, 0, []
    ones = np.zeros(64, np.int64)
    for stretch in stretches(text, step):
        words = held + stretch.lower().split()
        if len(words) >= k:
            ones += _ones(words, k, seed)
            n += len(words) - k + 1
        held = words[max(0, len(words) - k + 1) :]
    if not n and held:
        ones, n = _ones(held, len(held), seed), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _ones(words: list[bytes], k: int, seed: int) -> np.ndarray:
    """For each bit (the lowest first) the number of shingles of k words whose hash has it."""
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
    ends = ends[k - 1 :]
    digest = xxhash.xxh64_digest
    out = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        hashes = b"".join([digest(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        out += np.add.reduce(bits, axis=0, dtype=np.uint32)[::-1]
    return out


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of a set of 64-bit hashes, signed."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<i8", copy=False).view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def keys() -> list[Column]:
    """Two digests of a row's id and text, never null: together they tell rows apart."""
    return [F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(1), "text", "doc_id").alias("check")]


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, key, check, fp (long, its bits are the fingerprint's), one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [fingerprint(x, words_per_shingle, seed) for x in byte_texts(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], ["doc_id", "key", "check", "fp"])

    rows = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), *keys(), "text")
    return rows.mapInArrow(run, "doc_id long, key long, check long, fp long")


def patterns(spark: SparkSession) -> DataFrame:
    """half, syndrome, error, home: by which bits a half with that syndrome differs from each anchor within reach. About 6,000 rows, whatever the input."""
    rows = []
    for half, threshold in enumerate(HALF_THRESHOLDS):
        reach = RADIUS + threshold
        for weight in range(reach + 1):
            for places in combinations(range(1, 32), weight):
                syndrome, error = 0, 0
                for p in places:
                    syndrome ^= p
                    error |= 1 << (p - 1)
                rows.append((half, syndrome, error, weight == (syndrome != 0)))
                if weight < reach:
                    rows.append((half, syndrome, error | 1 << 31, False))
    return spark.createDataFrame(rows, "half int, syndrome int, error long, home boolean")


def _syndrome(bits: Column) -> Column:
    """The exclusive or of the places (from 1) of the bits set among the low 31."""
    out = F.lit(0)
    for j in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)
        out = out + (F.bit_count(bits.bitwiseAND(F.lit(mask).cast("long"))) % 2) * (1 << j)
    return out.cast("int")


def links(prints: DataFrame, sparing: bool = False) -> DataFrame:
    """Pairs a < b of the distinct fingerprints fp (signed) that differ in at most THRESHOLD bits. A pair may come more than once.

    sparing: a table of bits keeps most replicas at anchors that are nobody's home, which make no pair, from moving.
    """
    spark = prints.sparkSession
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned("fp", 32)
    halves = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("half"), x.alias("bits")) for i, x in enumerate((low, high))])).alias("x")).select("fp", "x.half", "x.bits")
    halves = halves.withColumn("syndrome", _syndrome(F.col("bits")))
    replicas = halves.join(F.broadcast(patterns(spark)), ["half", "syndrome"]).select((F.col("bits").bitwiseXOR(F.col("error")) + F.shiftleft(F.col("half").cast("long"), 32)).alias("anchor"), "fp", "home")
    homes = replicas.where("home").select("anchor", F.col("fp").alias("other"))
    if sparing:
        keyed = replicas.withColumn("key", F.xxhash64("anchor"))
        replicas = keyed.where(may_be_among(keyed.where("home").select("key")))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= THRESHOLD
    found = replicas.select("anchor", "fp").join(homes, "anchor").where(close & (F.col("fp") < F.col("other")))
    return found.select(F.col("fp").alias("a"), F.col("other").alias("b"))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, kept, key, check, one row per row of docs.

    docs: doc_id, text; other columns don't matter. Null texts count as empty; texts without words
    have fingerprint zero and link like any other. Rows with one fingerprint are one class, whatever
    its size. A document without an id takes part and gets its component's id, null if no member has
    one. kept: the document is its component's first, by id (null last), then by a digest; rows that
    repeat it wholly are marked too. No rows in, no rows out.
    """
    spark = docs.sparkSession
    prints = cut(fingerprints(docs, words_per_shingle, seed))
    parts = max(parallelism(spark), 2 * spark.sparkContext.defaultParallelism)
    out = with_firsts(prints, lambda classes: local_forests(links(classes.select("fp").repartition(parts))))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"), "kept", "key", "check")


def with_firsts(prints: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, key, check, fp of each row, with first (of its component, by id, null last, then by a digest) and kept: it is the first. link: pairs a, b of fp from the classes (fp, first)."""
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key", "check")
    classes = cut(prints.groupBy("fp").agg(F.min(first).alias("first")))
    roots = components(link(classes))
    joined = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    joined = cut(joined)
    firsts = cut(joined.groupBy("root").agg(F.min("first").alias("first")))
    of_class = cut(joined.select("fp", "root").join(firsts, "root").select("fp", "first"))
    out = prints.join(of_class, "fp")
    return out.withColumn("kept", (F.col("key") == F.col("first.key")) & (F.col("check") == F.col("first.check")))


def representatives(docs: DataFrame, words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """One row of docs, with all its columns, for each group of near-duplicates."""
    return kept_rows(docs, near_duplicates(docs, words_per_shingle, seed))


def kept_rows(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of docs that are marked as kept, once each. marked: key, check, kept, a row for each of docs.

    Rows that are kept and come once go through as they are; only what may be dropped is joined.
    """
    known = reused(marked.groupBy("key", "check").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    rows, doubtful = rows.select("row", *keys()), may_be_among(known.where("n > 1 or not kept").select("key"))
    some = rows.where(doubtful).join(known.where("kept").select("key", "check"), ["key", "check"], "left_semi").dropDuplicates(["key", "check"])
    return rows.where(~doubtful).select("row.*").unionByName(some.select("row.*"))
