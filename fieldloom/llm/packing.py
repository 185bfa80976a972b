"""Packing into optimal length buckets.

Texts longer than the model's window are cut into whole windows and a rest. A histogram of all piece
lengths (at most one bin for each length up to the window) gives, by dynamic programming, the bucket
boundaries that minimise padding. Inside each bucket pieces are numbered and cut into batches of as
many pieces as the token budget holds at the bucket's length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, n_words, reused

#: Pieces numbered in one window group; a bucket is dealt over as many groups as it needs.
GROUP_ROWS = 1024
#: Repeats of one document that one task makes out of their count.
REPEATS = 100_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most `buckets` upper bounds that minimise the padding of all pieces to the least bound not below them.

    lengths: ascending, distinct, positive. Bounds are lengths that occur, the last is the largest.
    Of equally good answers the one with the fewest buckets is taken. Padding is a Monge cost, so the
    best start of the last bucket never falls as its end rises: each bucket more costs n log n steps
    and n numbers of memory.
    """
    n = len(lengths)
    if not n:
        return []
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    number = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])

    def padding(i: np.ndarray | int, j: int) -> np.ndarray:
        """Of the lengths from the i-th to the one before the j-th, padded to the last of them."""
        return lengths[j - 1] * (number[j] - number[i]) - (tokens[j] - tokens[i])

    best = np.array([0, *(padding(0, j) for j in range(1, n + 1))])  # least padding of the first j lengths with the buckets so far
    steps, answers = [np.zeros(n + 1, np.int64)], [int(best[n])]
    for _ in range(1, min(buckets, n)):
        now, step = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        stack = [(1, n, 0, n - 1)]
        while stack:
            low, high, first, last = stack.pop()
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            through = best[i] + padding(i, j)
            k = int(through.argmin())
            now[j], step[j] = through[k], first + k
            if low < j:
                stack.append((low, j - 1, first, first + k))
            if j < high:
                stack.append((j + 1, high, first + k, last))
        best = now
        steps.append(step)
        answers.append(int(best[n]))
    k, end, out = int(np.argmin(answers)), n, []
    while end:
        out.append(int(lengths[end - 1]))
        end = int(steps[k][end])
        k = max(0, k - 1)
    return out[::-1]


def _digest(*columns: Column | str, between: str = "\n") -> Column:
    """60 bits of a digest that any engine has."""
    return F.conv(F.substring(F.md5(F.concat_ws(between, *columns)), 1, 15), 16, 10).cast("long")


def pack(docs: DataFrame, length: Column | None = None, window: int = 2048, buckets: int = 16, batch_tokens: int = 65536) -> DataFrame:
    """doc_id, piece, start, n_tokens, bucket_len, batch, slot, padding; one row per piece of a document.

    length: the tokens of a document, by default the words of its text. A piece is the tokens from
    `start` on; pieces of one document follow each other and cover it whole. (bucket_len, batch) is a
    batch: slots from 0 on, at most batch_tokens // bucket_len of them (at least one); all batches of
    a bucket but the last are full. Documents without tokens (null or empty texts) give one row with
    n_tokens 0 that is in no batch (bucket_len, batch and slot null). Rows that repeat a document are
    packed as often as they come: they are counted, and told apart by numbers. The order inside a
    bucket is that of a digest of document, piece and this number; ties go by id and piece. Very long
    texts are counted without a list of their words. No rows in, no rows out.
    """
    x = columns_of(docs, "doc_id", "text")
    n = (n_words(F.col("text")) if length is None else length).cast("long")
    sized = x.select("doc_id", n.alias("n"), _digest(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))).alias("digest")).groupBy("doc_id", "digest", "n").agg(F.count(F.lit(1)).alias("times"))
    sized = reused(sized)
    blocks = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS))).alias("block"))
    if sized.where(F.col("times") > REPEATS).limit(1).count():  # else each is one block
        blocks = blocks.repartition("digest", "block")
    most = F.least(F.col("times"), (F.col("block") + 1) * REPEATS)
    single = blocks.select("doc_id", "digest", "n", F.explode(F.sequence(F.col("block") * REPEATS, most - 1)).alias("copy"))
    pieces = single.select("doc_id", "digest", "copy", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / window)))).alias("piece"))
    pieces = pieces.select("doc_id", "digest", "copy", "piece", (F.col("piece") * window).alias("start"), F.least(F.lit(window).cast("long"), F.col("n") - F.col("piece") * window).alias("n_tokens"))
    # at most `window` rows, whatever the input
    bins = pieces.where("n_tokens > 0").groupBy("n_tokens").count().orderBy("n_tokens").limit(window).toPandas()
    bounds = boundaries(bins["n_tokens"].to_numpy(), bins["count"].to_numpy(), buckets)
    below = np.concatenate([[0], np.cumsum(bins["count"].to_numpy())])
    ends = below[np.searchsorted(bins["n_tokens"].to_numpy(), bounds, side="right")] if bounds else np.array([], np.int64)
    inside = np.diff(np.concatenate([[0], ends]))
    bucket, groups = F.lit(None).cast("int"), F.lit(1)
    for b, m in zip(bounds[::-1], inside[::-1].tolist(), strict=True):
        bucket = F.when(F.col("n_tokens") <= b, b).otherwise(bucket)
        groups = F.when(F.col("n_tokens") <= b, -(-int(m) // GROUP_ROWS)).otherwise(groups)
    some = pieces.where("n_tokens > 0").withColumn("bucket_len", bucket.cast("int"))
    some = some.withColumn("order", _digest("digest", "copy", "piece", between=":"))
    # parts follow the order, so numbers in a part and the sizes of the parts before it number a bucket
    some = some.withColumn("part", F.floor(F.col("order") / float(2**60) * groups).cast("long"))
    sizes = some.groupBy("bucket_len", "part").count()
    before = Window.partitionBy("bucket_len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket_len", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket_len", "part").orderBy("order", "doc_id", "piece")
    placed = some.withColumn("place", F.row_number().over(within) - 1).join(offsets, ["bucket_len", "part"])
    placed = placed.withColumn("place", F.col("place") + F.col("offset")).withColumn("room", F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("bucket_len"))))
    columns = ["doc_id", "piece", "start", "n_tokens", "bucket_len"]
    placed = placed.select(*columns, F.floor(F.col("place") / F.col("room")).alias("batch"), (F.col("place") % F.col("room")).cast("int").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
    empty = pieces.where("n_tokens <= 0").select("doc_id", "piece", "start", F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("int").alias("bucket_len"), F.lit(None).cast("long").alias("batch"), F.lit(None).cast("int").alias("slot"), F.lit(0).cast("long").alias("padding"))
    return placed.unionByName(empty)
