"""A quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins by quantiles. Training goes through the features in turn, again and
again: each time a shallow tree over one feature's bins, fitted to what is still unexplained, is added
to that feature's lookup table with a small step. Then the pairs of features whose joint bins explain
most of the rest get two-dimensional tables in the same way. A score is the logistic of the sum of
one entry from each table, so scoring is a handful of vectorised lookups.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, columns_of, small_batches, stretches

#: At most so many labelled documents are learned from, picked by a digest of their ids.
SAMPLE = 20_000
TARGET_COLUMN = "quality"

FEATURES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "log_longest_word", "upper", "digits", "other_bytes", "space",
    "lines_per_word", "stops", "commas", "exclaims", "bars", "symbols", "marked_words", "upper_words", "title_words",
    "distinct_words", "top_word", "repeats", "distinct_pairs", "distinct_lines", "byte_entropy", "word_entropy", "brackets", "links",
)

_SYMBOLS = np.zeros(256)
_SYMBOLS[[ord(c) for c in "#$%&*+/<=>@\\^_`{}~"]] = 1
_UPPER = slice(65, 91)
_MARKS = b"!#$%&*+/<=>?@\\^_`{|}~"


#: Words are listed for so many bytes at a time.
STRETCH = 1 << 20


def features(text: bytes, stretch: int = STRETCH) -> list[float]:
    """The figures of one whole text; all of them are defined for empty texts.

    A long text is read in stretches. What is kept of them are sums and digests of words, pairs and
    lines, from which the figures are made once, so they don't depend on the size of a stretch.
    """
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    hist = np.zeros(256, np.int64)
    m = total = squares = longest = marked = upper = title = same = 0
    words_seen, pairs_seen, last = [], [], []
    for part in stretches(text, stretch):
        hist += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        words = part.split()
        if not words:
            continue
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        m, total, squares, longest = m + len(words), total + int(lengths.sum()), squares + int((lengths * lengths).sum()), max(longest, int(lengths.max()))
        marked, upper, title = marked + sum(w[-1] in _MARKS for w in words), upper + sum(map(bytes.isupper, words)), title + sum(map(bytes.istitle, words))
        codes = np.array(last + list(map(hash, words)), np.int64)
        same += int((codes[1:] == codes[:-1]).sum())
        words_seen.append(np.unique(codes[len(last) :], return_counts=True))
        pairs_seen.append(np.unique(codes[:-1] * np.int64(0x5851F42D4C957F2D) + codes[1:]))
        last = [int(codes[-1])]
    each = np.ones(1)
    if m:
        codes, counts = np.concatenate([c for c, _ in words_seen]), np.concatenate([k for _, k in words_seen])
        each = np.sort(np.bincount(np.unique(codes, return_inverse=True)[1], counts))  # in an order that doesn't depend on the digests
    pairs = len(pairs_seen[0] if len(pairs_seen) == 1 else np.unique(np.concatenate(pairs_seen))) if m else 0
    n_lines, lines = 0, set()
    for line in io.BytesIO(text):
        if line := line.rstrip(b"\n"):
            n_lines += 1
            lines.add(hash(line))
    share = hist[hist > 0] / n
    words_or_1 = max(m, 1)
    p = each / each.sum()
    return [
        np.log1p(n), np.log1p(m), total / words_or_1, (max(0, m * squares - total * total)) ** 0.5 / words_or_1, np.log1p(longest),
        hist[_UPPER].sum() / n, hist[48:58].sum() / n, hist[128:].sum() / n, (hist[32] + hist[9:14].sum()) / n,
        hist[10] / words_or_1, hist[46] / words_or_1, hist[44] / words_or_1, hist[33] / words_or_1, hist[124] / words_or_1, (hist * _SYMBOLS).sum() / words_or_1,
        marked / words_or_1, upper / words_or_1, title / words_or_1,
        (len(each) if m else 0) / words_or_1, each.max() / words_or_1, same / words_or_1,
        pairs / max(m - 1, 1), len(lines) / max(n_lines, 1),
        -(share * np.log(share)).sum(), -(p * np.log(p)).sum(), (hist[40] + hist[41] + hist[91] + hist[93]) / words_or_1, text.count(b"://") / words_or_1,
    ]


def feature_matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(x) for x in texts], np.float64).reshape(len(texts), len(FEATURES))


# --- the model -----------------------------------------------------------------------------------


def _leaves(g: np.ndarray, h: np.ndarray, ridge: float, least: float, depth: int) -> np.ndarray:
    """The value for each bin of a tree of the given depth over bins with gradient g and weight h."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return out
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    c, d = g.sum() - a, h.sum() - b
    gain = np.where((b >= least) & (d >= least), a * a / (b + ridge) + c * c / (d + ridge), -np.inf)
    k = int(gain.argmax())
    if not np.isfinite(gain[k]) or gain[k] <= g.sum() ** 2 / (h.sum() + ridge) + 1e-12:
        return out
    return np.concatenate([_leaves(g[: k + 1], h[: k + 1], ridge, least, depth - 1), _leaves(g[k + 1 :], h[k + 1 :], ridge, least, depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best tree that cuts both axes of a table once: its value for each cell and its gain."""
    a, b = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    low_g, low_h = a[:-1, :-1], b[:-1, :-1]
    parts = []
    for x, y in ((low_g, low_h), (a[:-1, -1:] - low_g, b[:-1, -1:] - low_h), (a[-1:, :-1] - low_g, b[-1:, :-1] - low_h)):
        parts.append((x, y))
    parts.append((a[-1, -1] - sum(x for x, _ in parts), b[-1, -1] - sum(y for _, y in parts)))
    gain = sum(x * x / (y + ridge) for x, y in parts)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    value = [x[i, j] / (y[i, j] + ridge) for x, y in parts]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return out, float(gain[i, j] - a[-1, -1] ** 2 / (b[-1, -1] + ridge))


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += values[np.searchsorted(cuts, x[:, j], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.pair_cuts)]
            for i, j, values in self.pairs:
                out += values[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 250, step: float = 0.1, bins: int = 48, pair_bins: int = 12, n_pairs: int = 8, pair_rounds: int = 80, ridge: float = 1.0, least: float = 2.0) -> Model:
    """x: rows of features, y: 0 or 1. With no rows the score is 0.5, with one class it leans to that class."""
    n, width = x.shape
    good = float(y.sum())
    base = float(np.log((good + 0.5) / (n - good + 0.5)))
    cuts = [_cuts(x[:, j], bins) if n else np.zeros(0) for j in range(width)]
    pair_cuts = [_cuts(x[:, j], pair_bins) if n else np.zeros(0) for j in range(width)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    model = Model(base, cuts, tables, pair_cuts, [])
    if not 0 < good < n:
        return model
    binned = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    total = np.full(n, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            if len(tables[j]) < 2:
                continue
            g, h = slopes()
            add = step * _leaves(np.bincount(binned[j], g, len(tables[j])), np.bincount(binned[j], h, len(tables[j])), ridge, least, 2)
            tables[j] += add
            total += add[binned[j]]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(pair_cuts)]

    def table(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1)
        at = coarse[i] * shape[1] + coarse[j]
        g, h = slopes()
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    usable = [j for j in range(width) if len(pair_cuts[j])]
    gains = sorted(((_quadrants(*table(i, j), ridge)[1], i, j) for i, j in combinations(usable, 2)), reverse=True)
    chosen = [(i, j) for gain, i, j in gains[:n_pairs] if gain > 0]
    values = {ij: np.zeros((len(pair_cuts[ij[0]]) + 1, len(pair_cuts[ij[1]]) + 1)) for ij in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            add = step * _quadrants(*table(i, j), ridge)[0]
            values[i, j] += add
            total += add[coarse[i], coarse[j]]
    model.pairs = [(i, j, v) for (i, j), v in values.items()]
    return model


# --- over tables ---------------------------------------------------------------------------------


def held_out(doc_id):  # noqa: ANN001, ANN201
    """Rows kept out of training: crc32 of the id's text leaves 1 when divided by 3. False for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from at most `sample` labelled documents that aren't held out.

    A document labelled more than once has the mean of its labels, rounded half up; null labels don't
    count; of rows that repeat an id the one with the least figures does. Only the sample's ids are
    broadcast and only its features come to the driver.
    """
    known = columns_of(labels, "doc_id", TARGET_COLUMN).where(F.col(TARGET_COLUMN).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg(TARGET_COLUMN) >= 0.5).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = columns_of(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = feature_matrix(byte_texts(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["doc_id", "label", *FEATURES])

    figures = rows.mapInArrow(run, "doc_id long, label int, " + ", ".join(f"{f} double" for f in FEATURES))
    # one row an id, the least, so that at most `sample` rows come here however often an id is repeated
    found: pd.DataFrame = figures.groupBy("doc_id").agg(F.min(F.struct("label", *FEATURES)).alias("x")).select("x.*").toPandas()
    found = found.sort_values(["label", *FEATURES])  # the same model whatever order the rows came in
    return train(found[list(FEATURES)].to_numpy(np.float64).reshape(len(found), len(FEATURES)), found["label"].to_numpy(np.float64))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            score = model.score(feature_matrix(byte_texts(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return columns_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text), empty and null texts too.

    Only texts are looked at: ids, languages and sources are no inputs. Equal texts have equal scores.
    No labels at all: every score is 0.5. No rows in, no rows out.
    """
    found = scores(docs, learn(docs, labels, sample))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least 0.5."""
    model = learn(docs, labels, sample)
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keep = model.score(feature_matrix(byte_texts(batch.column(place)))) >= 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
