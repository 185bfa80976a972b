"""Helpers shared by the operators: tables, lineage cuts and byte views of texts."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkContext, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, shared_dir


#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reused(frame: DataFrame) -> DataFrame:
    """The frame, kept on the executors' disks from its first use on, for plans that read it several times.

    Its lineage stays, so what a lost executor held is made anew. The condition is always true and goes when the
    plan is optimised; it keeps Spark from taking an earlier table of an equal plan, whose files may have changed.
    """
    tag = F.lit(uuid.uuid4().hex)
    frame = frame.where(tag == tag).persist(StorageLevel.DISK_ONLY)
    _held.setdefault(frame.sparkSession.sparkContext.applicationId, []).append(frame)
    return frame


def freed(*frames: DataFrame) -> None:
    """Give up frames that reused() gave, once what was made of them is held itself."""
    for frame in frames:
        frame.unpersist()


_held: dict[str, list[DataFrame]] = {}


def tables_dir(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    folder = f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"
    if folder not in _used:
        _used.add(folder)
        atexit.register(_delete, folder)
    return folder


_used: set[str] = set()


def _delete(folder: str) -> None:
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Free the tables that operators hold or have written so far. Results that haven't been read to the end make what they need anew; those that read a written table fail."""
    for frame in _held.pop(spark.sparkContext.applicationId, []):
        frame.unpersist()
    _delete(tables_dir(spark))


def may_be_among(keys: DataFrame) -> Column:
    """Whether a row's key (a digest) may be among keys: true for all that are, and for few others.

    A table of at most 16 MB has a bit for each key. It only spares joins rows that they would drop; with many
    more keys than bits it spares less.
    """
    words = 1 << min(21, max(6, (keys.count() * 12 // 64).bit_length()))
    at = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(words - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("key").bitwiseAND(F.lit(63)).cast("int"))
    found = keys.select(at.alias("id"), bit.alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(words).join(found, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")).alias("x"))
    table = cut(every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias("bits")))
    return F.get(table.scalar(), at.cast("int")).bitwiseAND(bit) != 0


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices, so that what a kernel holds beside its input stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_GAP = re.compile(rb"[\x20\x09-\x0d]")


def stretches(text: bytes, size: int) -> Iterator[bytes]:
    """The text in stretches of about `size` bytes, cut at white space."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def columns_of(frame: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by position in the frame, so that extra ones can't clash."""
    return frame.select(*[frame[n] for n in names])


def n_words(text: Column) -> Column:
    """The number of words of a text, 0 for null. Each word and the white space after it becomes one letter, so that no list of a long text's words is made."""
    shrunk = F.regexp_replace(F.ltrim(text, F.lit(SPACE)), F.lit(r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"), F.lit("x"))
    return F.coalesce(F.length(shrunk), F.lit(0)).cast("long")
