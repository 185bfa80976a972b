"""Vectors compressed to one code a part: product quantisation in whole numbers.

The vectors are held as columnar blocks: a block has some thousand vectors, one contiguous row of whole
numbers for each dimension. In a round every block adds its vectors to the nearest entries of the
codebooks, part by part: squared distances accumulate dimension by dimension, np.add.at adds what each
entry got into int64 tensors of sums and counts, and treeAggregate merges the tensors of all blocks in a
tree. The driver only sees the merged tensors, whose size is that of the codebooks. All arithmetic is
exact, so neither the order of blocks nor their number changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, reused

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block.
ROWS = 1024
#: Levels in which the tensors of all tasks are merged.
DEPTH = 2

Tensors = tuple[np.ndarray, np.ndarray]


def kept(column: Column) -> Column:
    """Not null, every component a finite number."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False))


def whole_numbers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as int64 if sums of 2^40 of them are sure to fit, else as Python's whole numbers."""
    scaled = np.floor(scale * x.astype(np.float64))
    if np.abs(scaled).max(initial=0) < 2.0**23:
        return scaled.astype(np.int64)
    return np.array([int(v) for v in scaled.ravel().tolist()], object).reshape(scaled.shape)


def _kind(x: np.ndarray, c: np.ndarray) -> type:
    """The narrowest kind of whole number that holds every sum of squares of differences."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    bits = (reach * reach * max(1, len(x))).bit_length()
    return np.int32 if bits < 31 else np.int64 if bits < 63 else object


def nearest(columns: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each vector, the lower index at ties. columns: dimension x vectors; entries: entry x dimension."""
    kind = _kind(columns, entries)
    x, c = columns.astype(kind), entries.T.astype(kind)
    distance = np.zeros((columns.shape[1], len(entries)), kind)
    step = np.empty_like(distance)
    for d in range(len(x)):
        np.subtract(x[d][:, None], c[d][None, :], out=step)
        np.multiply(step, step, out=step)
        np.add(distance, step, out=distance)
    index = distance.argmin(axis=1)
    return index, distance[np.arange(len(index)), index]


def _blocks(rows: DataFrame, dimension: int, scale: int, size: int) -> DataFrame:
    """vec_id, label (lists), n, x (n columns of `dimension` int64 each, or decimal digits where these don't hold them) for each block of the rows (vec_id, label, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = whole_numbers(np.asarray(part.column(2).flatten()).reshape(part.num_rows, dimension), scale).T
                data = np.ascontiguousarray(x).tobytes() if x.dtype != object else ",".join(map(str, x.ravel().tolist())).encode()
                lists = [pa.array([part.column(k).to_pylist()], pa.list_(part.column(k).type)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([part.num_rows], pa.int32()), pa.array([x.dtype == object]), pa.array([data], pa.binary())], ["vec_id", "label", "n", "wide", "x"])

    kind = dict(rows.dtypes)["label"]
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id array<long>, label array<{kind}>, n int, wide boolean, x binary")


def _columns(n: int, wide: bool, data: bytes) -> np.ndarray:
    if wide:
        return np.array([int(v) for v in bytes(data).decode().split(",")], object).reshape(-1, n)
    return np.frombuffer(data, np.int64).reshape(-1, n)


def _added(tensors: Tensors | None, block: np.ndarray, books: np.ndarray) -> Tensors:
    """The tensors of sums (part, entry, position) and counts (part, entry) with the vectors of a block."""
    parts, entries, width = books.shape
    kind = object if block.dtype == object or books.dtype == object else np.int64
    sums, counts = tensors or (np.zeros((parts, entries, width), kind), np.zeros((parts, entries), np.int64))
    if kind is object and sums.dtype != object:
        sums = sums.astype(object)
    for p in range(parts):
        part = block[p * width : (p + 1) * width]
        index, _ = nearest(part, books[p])
        np.add.at(sums[p], index, part.T)
        np.add.at(counts[p], index, 1)
    return sums, counts


def _merged(a: Tensors | None, b: Tensors | None) -> Tensors | None:
    return (a[0] + b[0], a[1] + b[1]) if a and b else a or b


def train(blocks: DataFrame, books: np.ndarray, rounds: int, depth: int = DEPTH) -> np.ndarray:
    """The codebooks (part, entry, position) after some rounds from `books`. An entry that no vector is nearest to stays."""
    arrays = blocks.select("n", "wide", "x").rdd.map(lambda r: _columns(*r))
    for _ in range(rounds):
        tensors = arrays.treeAggregate(None, lambda t, x, b=books: _added(t, x, b), _merged, depth)
        if tensors is None:
            break
        sums, counts = tensors
        used = counts > 0
        books = books.astype(sums.dtype)
        books[used] = sums[used] // counts[used][:, None]
    return books


def _coded(blocks: DataFrame, books: np.ndarray, label: str) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    parts, _, width = books.shape
    digits = [f"{k:02x}" for k in range(books.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels, n, wide, data = (batch.column(c)[k] for c in range(5))
                x = _columns(n.as_py(), wide.as_py(), data.as_py())
                found = [nearest(x[p * width : (p + 1) * width], books[p]) for p in range(parts)]
                codes = ["".join(digits[i] for i in row) for row in zip(*(index.tolist() for index, _ in found), strict=True)]
                errors = [sum(row) for row in zip(*(d.tolist() for _, d in found), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def digest(books: np.ndarray) -> str:
    """Lowercase hex of all entries' components, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = ROWS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error, codebooks_sha256 for each kept row; the codebooks).

    vectors: vec_id, embedding, label; other columns don't matter. Rows whose vector is null or holds null or
    non-finite components are dropped. The dimension is the length of the first kept vector (by vec_id, null last,
    then by components) that divides into parts; vectors of other lengths have neither code nor error. The first
    codebooks are the vectors of the least vec_ids; rows that repeat one count each; with fewer rows than entries
    there are fewer. Whole numbers of any size are exact; an error, or a sum of errors, beyond 64 bits raises. No rows in, no rows out.
    """
    spark = vectors.sparkSession
    rows = columns_of(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v")).where(kept(F.col("v")))
    fit = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = fit.orderBy(*order).limit(1).select(F.size("v").alias("d")).first()
    d = first["d"] if first else 0
    fit = fit.where(F.size("v") == d)
    least = whole_numbers(np.array([r["v"] for r in fit.orderBy(*order).limit(entries).select("v").collect()], np.float64).reshape(-1, max(d, 1)), scale)
    books = np.ascontiguousarray(least.reshape(len(least), parts, -1).transpose(1, 0, 2)) if d else np.zeros((parts, 0, 0), np.int64)
    label = dict(rows.dtypes)["label"]
    coded = spark.createDataFrame([], f"vec_id long, label {label}, code string, error long")
    if d:
        blocks = reused(_blocks(fit, d, scale, block))
        books = train(blocks, books, rounds)
        coded = _coded(blocks, books, label)
    others = rows.where(F.size("v") != d).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    out = reused(coded.unionByName(others))
    sums = out.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = out.join(sums.withColumnRenamed("label", "l"), F.col("label").eqNullSafe(F.col("l")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), books


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id and the vector (array<double>) that the entries of its code stand for: the middle of what floors to them."""
    middles = [[[(v + 0.5) / scale for v in entry] for entry in part] for part in books.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if c is None else [v for p, i in enumerate(bytes.fromhex(c)) for v in middles[p][i]] for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")
