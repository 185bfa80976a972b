"""How filters of documents overlap: what each removes in every order, alone, in vain and on average.

A document's failures are one mask of five bits, so all orders follow from the number of documents with
each mask: per part at most 32 rows of counts, whatever the input.

Four of the bits come from the text alone. The fifth, whether a smaller id has the same text, comes from
partition refinement: documents are split by code-point length, then by the hash of one block of the text
after the other, and what is alone in its class is dropped in every round. The texts of the classes that
are left are compared whole; only they are read again and moved, and copies collapse where they are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, columns_of, freed, may_be_among, reused, small_batches, stretches

#: Few words, repeated words, capitals, markup, copies; a filter's bit is its place.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
#: Code points at which a block of a text ends; the last goes to the end of the text.
BLOCKS = (64, 1024)

_MARKUP = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of UTF-8 that don't begin a code point.
_INNER = bytes(range(0x80, 0xC0))


def failures(text: bytes, step: int = 1 << 20) -> int:
    """The bits of the filters A to D that a text fails. Long texts are read in stretches; their distinct words are held."""
    n, distinct = 0, set()
    for stretch in stretches(text, step):
        words = stretch.split()
        n += len(words)
        distinct.update(words)
    points = len(text.translate(None, _INNER))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (n < MIN_WORDS) | (100 * len(distinct) < MIN_DISTINCT * n) << 1 | (100 * capitals > MAX_CAPITALS * points) << 2 | (_MARKUP.search(text) is not None) << 3


def _masked(rows: DataFrame) -> DataFrame:
    """rows (doc_id, part, text, length, blocks) with the mask of A to D in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            masks = pa.array([failures(x) for x in byte_texts(batch.column(0))], pa.int32())
            yield pa.RecordBatch.from_arrays([masks, *batch.columns[1:]], ["mask", "doc_id", "part", "length", "blocks"])

    return rows.select("text", "doc_id", "part", "length", "blocks").mapInArrow(run, "mask int, doc_id long, part string, length int, blocks array<long>")


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, part, text, its length in code points and the hash of each of its blocks."""
    rows = columns_of(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    starts = [0, *BLOCKS]
    blocks = [F.xxhash64(F.substring("text", a + 1, b - a)) for a, b in zip(starts, [*BLOCKS, 2**31 - 1], strict=True)]
    return rows.withColumns({"length": F.length("text"), "blocks": F.array(*blocks)})


def _class(rounds: int, bits: int) -> Column:
    """The class of a row after so many rounds of refinement, as a digest of `bits` bits."""
    return F.shiftrightunsigned(F.xxhash64("length", *[F.get("blocks", F.lit(k)) for k in range(rounds)]), 64 - bits)


def _several(rows: DataFrame) -> DataFrame:
    return reused(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))


def refined(rows: DataFrame, bits: int = 64) -> DataFrame:
    """key of each class of rows (length, blocks) in which at least two are left after all rounds; a superset of the texts that occur twice."""
    held = []
    for rounds in range(len(BLOCKS) + 2):
        rows = rows.withColumn("key", _class(rounds, bits))
        keys = _several(rows)
        # a row that passes by chance (the table of bits holds no keys) is counted, and told apart, again
        rows = rows.where(may_be_among(keys))
        held.append(keys)
    freed(*held[:-1])
    return held[-1]


def marked(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, part, mask for each row of docs (doc_id, text, lang); mask has a bit for each filter that it fails.

    A row fails E if a row with a smaller doc_id has the same text; rows that repeat the smallest don't, nor do
    rows without an id, which aren't smaller than any either. Null texts are empty.
    """
    source = _hashed(docs)
    rows = reused(_masked(source).withColumn("key", _class(len(BLOCKS) + 1, bits)))
    keys = refined(rows.select("length", "blocks"), bits)
    texts = source.withColumn("key", _class(len(BLOCKS) + 1, bits)).where(may_be_among(keys)).select("key", "text", "doc_id")
    compared = reused(texts.groupBy("key", "text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    classes = reused(compared.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1"))
    calm, mixed = classes.where("texts = 1").select("key", "first"), classes.where("texts > 1").select("key")
    copy = F.when(F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)), COPY).otherwise(0)
    possible = may_be_among(classes.select("key"))
    plain = rows.where(~possible).select("doc_id", "part", "mask")
    some = rows.where(possible).join(calm, "key", "left")
    if not mixed.take(1):
        return plain.unionByName(some.select("doc_id", "part", (F.col("mask") + copy).alias("mask")))
    # different texts of one class: the text itself tells its rows apart
    some = some.join(mixed, "key", "left_anti").select("doc_id", "part", (F.col("mask") + copy).alias("mask"))
    odd = source.withColumn("key", _class(len(BLOCKS) + 1, bits)).join(mixed, "key", "left_semi").join(compared.select("key", "text", "first"), ["key", "text"])
    odd = odd.select(F.col("doc_id"), F.struct("part", (F.col("doc_id") > F.col("first")).alias("copy")).alias("x"), "text", "length", "blocks")
    told = odd.select("doc_id", F.to_json("x").alias("part"), "text", "length", "blocks")
    told = _masked(told).withColumn("x", F.from_json("part", "part string, copy boolean"))
    told = told.select("doc_id", "x.part", (F.col("mask") + F.when(F.coalesce("x.copy", F.lit(False)), COPY).otherwise(0)).alias("mask"))
    return plain.unionByName(some).unionByName(told)


def _outcomes() -> pd.DataFrame:
    """What becomes of a document with each mask at each step of each order: 32 x 120 x 5 rows."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        for step, i in enumerate(order):
            before = sum(1 << k for k in order[:step])
            for mask in range(1 << len(FILTERS)):
                fails, gone = mask >> i & 1, int(mask & before != 0)
                share = factorial(len(FILTERS)) // mask.bit_count() if fails else 0
                rows.append((mask, name, step + 1, int(not gone and not fails), int(fails and not gone), int(fails and gone), int(mask == 1 << i), share))
    return pd.DataFrame(rows, columns=["mask", "filter_order", "step", "keeps", "removes", "repeats", "alone", "share"])


def interactions(docs: DataFrame, labels: DataFrame, bits: int = 64) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic; other columns don't matter. A part for each lang
    (null is the empty string), 600 rows each. A document is good (toxic) if any of its labels says so; documents
    and labels without an id don't meet. Rows that repeat a document count each. No rows in, no rows out.

    bits: of a class's digest; fewer than 64 only serve tests, since texts are compared in any case.
    """
    spark = docs.sparkSession
    told = columns_of(labels, "doc_id", "quality", "toxic").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    told = told.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    rows = marked(docs, bits).join(told, "doc_id", "left")
    counts = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    # 19,200 rows, whatever the input
    each = counts.join(F.broadcast(spark.createDataFrame(_outcomes())), "mask")
    total = lambda n, flag: F.sum(F.col(n) * F.col(flag)).cast("long")
    out = each.groupBy("part", "filter_order", F.col("step").cast("int").alias("step"))
    return out.agg(
        total("n", "keeps").alias("kept"), total("n", "removes").alias("removed"), total("n", "repeats").alias("redundant"), total("n", "alone").alias("unique_fails"),
        total("good", "removes").alias("good_lost"), total("toxic", "removes").alias("toxic_lost"), total("n", "share").alias("shapley"),
    )


def passed(docs: DataFrame, filters: str = FILTERS) -> DataFrame:
    """doc_id, part, mask of the rows of docs that fail none of the filters named."""
    unknown = sum(1 << FILTERS.index(f) for f in set(filters))
    return marked(docs).where(F.col("mask").bitwiseAND(F.lit(unknown)) == 0)
