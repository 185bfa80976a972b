"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. Its documents are first taken whole as often as the target holds
the source whole; what is left of the target is a sample. For the sample every document has an
inclusion probability, which grows with the root of its size. Those of probability 1 are certain; the
others are ranked by their random odds (from a digest of the document) divided by their inclusion
odds, and the first in that order are taken up to the number of words left, so the sample's size is
fixed. Where a document doesn't fit any more, the order goes on to those that still do, and then once
more through all of them for another copy, until less than half a median document is missing.

The cut in the order is found without sorting a source: two histograms of the rank narrow it down to
about a millionth of the source's documents, which are then put in order. A source of any share of
the rows, and any number of repeats of one row, are handled by partial aggregation only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, cut, n_words, reused

#: The rank is an integer of RANK_BITS bits; each histogram takes STEP_BITS of them. A further copy of a document ranks 2^UNIT_BITS later.
RANK_BITS, STEP_BITS, UNIT_BITS = 50, 10, 51
#: Up to so many sources (of a long, a double and a few more each) are broadcast; beyond, they are joined by a shuffle and held as checkpoints.
BROADCAST_SOURCES = 1000

_PLACE = "struct<rank:bigint,tie:bigint,row:bigint>"
_CUTS = f"array<struct<after:{_PLACE},last:{_PLACE},most:double>>"


def _source_key(source: Column) -> Column:
    """A key that is never null: sources by code point, null after all others."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    """One row per document, without its text: doc_id, key, size, u (uniform between 0 and 1), tie, row (tells repeats of a row apart)."""
    return columns_of(docs, "doc_id", "text", "source").select("doc_id", *_measures(seed))


def _measures(seed: int) -> list[Column]:
    digest = F.xxhash64(F.lit(seed), "doc_id", "text")
    return [
        _source_key(F.col("source").cast("string")).alias("key"),
        n_words(F.col("text")).alias("size"),
        ((F.shiftrightunsigned(digest, 12).cast("double") + 0.5) / float(2**52)).alias("u"),
        F.xxhash64(F.lit(seed + 1), "text", "doc_id").alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    ]


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), ceiling: float = 3.0) -> DataFrame:
    """sources (key, source_size) with weight and target: all words shared by weight, no target above
    ceiling times its source, the excess reshared until none is. One round for each time that further
    sources reach their ceiling; only sums come to the driver."""
    spark = sources.sparkSession
    cycle = [float(w) for w in weights]
    sources = sources.select("key", "source_size")
    if len(sources.take(BROADCAST_SOURCES + 1)) <= BROADCAST_SOURCES:
        turn = F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(cycle)))
        ranked = _held(sources.withColumn("weight", F.get(F.array(*[F.lit(w) for w in cycle]), turn)), 0)
    else:
        ordered = sources.orderBy("key").rdd.zipWithIndex()
        ranked = cut(spark.createDataFrame(ordered.map(lambda x: (x[0][0], x[0][1], cycle[x[1] % len(cycle)])), "key string, source_size long, weight double"))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    most = F.col("source_size") * ceiling
    level, before = 0.0, -1
    capped = F.lit(False)
    while True:
        n, full, free = ranked.agg(F.count(F.when(capped, 1)), F.sum(F.when(capped, most)), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == before or not free:
            break
        before, level = n, max(0.0, total - (full or 0.0)) / free
        capped = most <= F.col("weight") * level
    return ranked.withColumn("target", F.when(capped, most).otherwise(F.col("weight") * level))


def _appeal(power: float) -> Column:
    """The inclusion probability, or 1 and more for a certain document."""
    return F.col("scale") * F.pow(F.col("size").cast("double"), F.lit(power))


def _rank(power: float) -> Column:
    """The place in Pareto order as an integer: random odds over inclusion odds, q, as floor(2^RANK_BITS * q / (1 + q)); null for what isn't sampled at all."""
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-9), _appeal(power)))
    q = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    return F.when((F.col("rest") > 0) & (F.col("size") > 0), F.least(F.lit(2**RANK_BITS - 1), F.floor(q / (1 + q) * float(2**RANK_BITS))).cast("long"))


def _small(frame: DataFrame, n_sources: int) -> DataFrame:
    """A table of a few rows a source, for a join."""
    return F.broadcast(frame) if n_sources <= BROADCAST_SOURCES else frame


def _held(frame: DataFrame, n_sources: int) -> DataFrame:
    """A table of a row a source, computed: by the driver, which broadcasts it, as long as _small() does; as a checkpoint beyond."""
    return frame.sparkSession.createDataFrame(frame.toArrow(), frame.schema) if n_sources <= BROADCAST_SOURCES else cut(frame)


def _with_sources(rows: DataFrame, sources: DataFrame, n_sources: int, power: float) -> DataFrame:
    return rows.join(_small(sources, n_sources), "key").withColumn("rank", _rank(power)).withColumn("certain", _appeal(power) >= 1)


def _scaled(measured: DataFrame, goal: DataFrame, power: float) -> DataFrame:
    """goal with scale (probability = scale * size^power), left (words to sample besides certain documents) and near (half the median size).

    Sizes from the largest on are certain as long as their probability would be above 1. The tables
    here have a row for each source and size, which the longest text bounds, not the number of rows.
    """
    sizes = cut(measured.where("size > 0").groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    x = sizes.join(goal.select("key", "rest", "n_full"), "key").withColumn("f", F.pow(F.col("size").cast("double"), F.lit(power)))
    down = Window.partitionBy("key").orderBy(F.desc("size"))
    above = F.coalesce(F.sum(F.col("n") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("n") * F.col("size") * F.col("f")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    seen = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.select("*", ((F.col("rest") - above) / below).alias("scale"), seen.alias("seen"))
    found = x.groupBy("key").agg(F.max_by(F.when(F.col("scale") * F.col("f") <= 1, F.col("scale")), F.when(F.col("scale") * F.col("f") <= 1, F.col("size"))).alias("scale"), (F.max(F.when(F.col("seen") * 2 >= F.col("n_full"), F.col("size"))) / 2).alias("near"))
    goal = goal.join(found, "key", "left").withColumn("scale", F.coalesce("scale", F.lit(0.0)))
    sure = sizes.join(goal.select("key", "scale"), "key").where(_appeal(power) >= 1).groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("sure"))
    return goal.join(sure, "key", "left").withColumn("left", F.greatest(F.lit(0.0), F.col("rest") - F.coalesce("sure", F.lit(0))))


def _ends(ranked: DataFrame, open_: DataFrame, n_sources: int) -> DataFrame:
    """key, last, gap: how far the order of each source goes while its words fit, and the words still missing.

    ranked: key, size, rank, tie, row. open_: key, left. Sources whose first row doesn't fit have no row here.
    """
    found = open_.select("key", F.lit(0).cast("long").alias("start"), "left")
    shift = RANK_BITS + 2
    for _ in range(2):
        wide, shift = shift, shift - STEP_BITS - 1
        at = ranked.select("key", "size", F.shiftright("rank", shift).alias("bucket"), F.shiftright("rank", wide).alias("outer"))
        here = found.select("key", F.shiftright("start", wide).alias("outer"), "left")
        bins = at.join(_small(here, n_sources), ["key", "outer"]).groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.max("left").alias("left"))
        up_to = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("sum", F.sum("words").over(up_to)).where("sum - words <= left")
        # a few thousand rows a source at most: the bucket in which its words run out
        last = bins.groupBy("key").agg(F.max_by(F.struct("bucket", (F.col("left") - F.col("sum") + F.col("words")).alias("left")), "bucket").alias("x"))
        found = _held(last.select("key", F.shiftleft("x.bucket", shift).alias("start"), F.col("x.left").alias("left")), n_sources)
    here = found.select("key", F.shiftright("start", shift).alias("bucket"), "left")
    few = ranked.withColumn("bucket", F.shiftright("rank", shift)).join(_small(here, n_sources), ["key", "bucket"])
    ties = few.groupBy("key", "rank", "tie").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("row").alias("row"), F.max("left").alias("left"))
    up_to = Window.partitionBy("key").orderBy("rank", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ties = ties.withColumn("sum", F.sum(F.col("size") * F.col("n")).over(up_to)).withColumn("before", F.col("sum") - F.col("size") * F.col("n"))
    ties = ties.withColumn("fit", F.least(F.col("n"), F.floor((F.col("left") - F.col("before")) / F.col("size")))).where("before <= left and fit > 0")
    last = ties.groupBy("key").agg(F.max(F.struct("rank", "tie", "row", "fit", "n", "size", "before", "left")).alias("x")).select("key", "x.*")
    # nothing of the last bucket fits: the order ends before it
    whole = found.join(last.select("key", "rank", "tie", "row", "fit", "n", (F.col("left") - F.col("before") - F.col("fit") * F.col("size")).alias("gap")), "key", "left")
    whole = _held(whole.select("key", F.coalesce("rank", F.col("start") - 1).alias("rank"), F.coalesce("tie", F.lit(2**63 - 1)).alias("tie"), F.coalesce("row", F.lit(2**63 - 1)).alias("row"), F.coalesce("gap", "left").alias("gap"), (F.col("fit") < F.col("n")).alias("split"), "fit"), n_sources)
    split = whole.where("split").select("key", "rank", "tie", "fit")
    if not split.isEmpty():  # repeats of one row, of which only the first fit: by the parts that they stand in, then inside one part
        rows = ranked.join(_small(split, n_sources), ["key", "rank", "tie"]).withColumn("part", F.shiftright("row", 33))
        parts = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.max("fit").alias("fit"))
        parts = parts.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
        one = _held(parts.where("before < fit and fit <= before + n").select("key", "part", (F.col("fit") - F.col("before")).alias("wanted")), n_sources)
        inside = rows.join(_small(one, n_sources), ["key", "part"]).withColumn("number", F.row_number().over(Window.partitionBy("key").orderBy("row"))).where("number = wanted")
        whole = whole.join(inside.select("key", F.col("row").alias("at")), "key", "left").withColumn("row", F.coalesce("at", "row"))
    return whole.select("key", F.struct("rank", "tie", "row").alias("last"), "gap")


def plan(measured: DataFrame, weights: Sequence[float] = (5, 2, 1), ceiling: float = 3.0, power: float = 0.5) -> tuple[DataFrame, int]:
    """Per source: key, source_size, target, whole (copies that all documents get), rest (words to sample), scale, cuts (stretches of the order that are taken, each up to a size); and the number of sources."""
    sums = reused(measured.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n_full")))
    n_sources = sums.count()
    sums = _held(sums, n_sources)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = targets(sums, weights, ceiling).withColumn("whole", F.floor(share + 1e-9).cast("long"))
    goal = goal.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    goal = goal.withColumn("rest", F.when(F.col("rest") < 1, 0.0).otherwise(F.col("rest"))).join(sums.select("key", "n_full"), "key").select("key", "source_size", "n_full", "target", "whole", "rest")
    units = F.greatest(F.lit(1).cast("long"), F.lit(int(ceiling)).cast("long") - F.col("whole"))
    goal = _held(_scaled(measured, _held(goal, n_sources), power).withColumn("units", units), n_sources)
    start = F.struct(F.lit(-1).cast("long").alias("rank"), F.lit(0).cast("long").alias("tie"), F.lit(0).cast("long").alias("row"))
    state = _held(goal.select("key", F.col("left").alias("gap"), "near", start.alias("after"), F.array().cast(_CUTS).alias("cuts")), n_sources)
    ranked = _with_sources(measured, goal, n_sources, power).where("rank is not null").select("key", "size", "rank", "tie", "row", "certain", "units")
    first = True
    while True:
        active = state.where("gap > 0" if first else "gap > near").select("key", F.col("gap").alias("left"), "after")
        rows = ranked.withColumn("unit", F.lit(0).cast("long")) if first else ranked.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)))
        rows = rows.where("unit > 0 or not certain").withColumn("rank", F.col("rank") + F.col("unit") * 2**UNIT_BITS)
        rows = rows.join(_small(active, n_sources), "key").where((F.col("size") <= F.col("left")) & (F.struct("rank", "tie", "row") > F.col("after")))
        ends = _held(_ends(rows.select("key", "size", "rank", "tie", "row"), active.select("key", "left"), n_sources).withColumnRenamed("gap", "missing"), n_sources)
        if ends.isEmpty():
            break
        more = F.array(F.struct("after", "last", F.col("gap").alias("most")))
        state = state.join(ends, "key", "left").select("key", F.coalesce("missing", "gap").alias("gap"), "near", F.coalesce("last", "after").alias("after"), F.when(F.col("last").isNull(), F.col("cuts")).otherwise(F.concat("cuts", more)).alias("cuts"))
        state, first = _held(state, n_sources), False
    # where nothing fits any more but much is missing: the smallest that brings the sum nearer
    short = state.where("gap > near").select("key", "gap", "cuts")
    if not short.isEmpty():
        rows = ranked.join(_small(short, n_sources), "key").withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1))).where("unit > 0 or not certain")
        rows = rows.withColumn("at", F.struct((F.col("rank") + F.col("unit") * 2**UNIT_BITS).alias("rank"), "tie", "row")).where((F.col("size") > F.col("gap")) & (F.col("size") < 2 * F.col("gap")) & ~_taken(F.col("at")))
        one = rows.groupBy("key").agg(F.min(F.struct("size", "at")).alias("x")).select("key", F.struct(F.struct("x.at.rank", "x.at.tie", (F.col("x.at.row") - 1).alias("row")).alias("after"), F.col("x.at").alias("last"), F.col("x.size").cast("double").alias("most")).alias("one"))
        state = state.join(one, "key", "left").withColumn("cuts", F.when(F.col("one").isNull(), F.col("cuts")).otherwise(F.concat("cuts", F.array("one"))))
    return _held(goal.join(state.select("key", "cuts"), "key"), n_sources), n_sources


def _taken(at: Column) -> Column:
    """Whether a place of the order is in one of the stretches that are taken."""
    return F.exists("cuts", lambda c: (at > c["after"]) & (at <= c["last"]) & (F.col("size") <= c["most"]))


def _copies(ceiling: float) -> Column:
    out = F.col("whole")
    for unit in range(max(1, int(ceiling))):
        at = F.struct((F.col("rank") + F.lit(unit * 2**UNIT_BITS)).alias("rank"), F.col("tie"), F.col("row"))
        taken = (F.col("certain") | _taken(at)) if unit == 0 else (F.lit(unit) < F.col("units")) & _taken(at)
        out = out + F.when(F.col("rank").isNotNull() & taken, 1).otherwise(0)
    return out.cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), ceiling: float = 3.0, power: float = 0.5, seed: int = 6) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row of docs (doc_id, text, source).

    Null texts have size 0. A null source is a source, last in order. Documents of size 0 take no
    words; a source without words has target 0. Rows that repeat a document wholly (id and text) share
    its place in the order, in which they stand as in the table; so do ties. Long texts are counted
    without a list of their words. power: the inclusion probability of a sampled document is in
    proportion to its size to this power. The digests depend on id, text and seed alone, so reruns
    agree. A source misses its target by half its median document at most, unless no document that it
    has comes nearer: with all copies allowed taken, each one left would pass the target by more. No
    rows in, no rows out.
    """
    measured = reused(_measured(docs, seed))
    sources, n = plan(measured, weights, ceiling, power)
    rows = _with_sources(measured, sources, n, power).withColumn("copies", F.when(F.col("size") > 0, _copies(ceiling)).otherwise(F.lit(0).cast("long")))
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), ceiling: float = 3.0, power: float = 0.5, seed: int = 6) -> DataFrame:
    """The rows of docs, each as often as mix() takes it, with all their columns. Documents without words are kept once."""
    sources, n = plan(reused(_measured(docs, seed)), weights, ceiling, power)
    packed = docs.select(F.struct("*").alias("whole_row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["source"].alias("source"))
    x = packed.select("whole_row", *_measures(seed))
    x = _with_sources(x, sources, n, power).withColumn("copies", F.when(F.col("size") > 0, _copies(ceiling)).otherwise(F.lit(1).cast("long")))
    return x.where("copies > 0").select("whole_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("whole_row.*")
