"""Quality of texts by a generalised additive model with pairwise interactions.

A text becomes a fixed row of numbers (shares of kinds of characters in the whole text and in its
worst stretches, repetition, shape). Each feature is cut into bins at quantiles. Training goes
round the features in turn and adds a small step of a shallow tree over the bins of one feature at
a time, which leaves one lookup table per feature; then the pairs whose residuals promise most get
tables over two features in the same way. A score is the logistic of a sum of table entries.

The model is fitted on the driver, on at most ``MOST_LABELLED`` labelled rows chosen by a hash of
their id (a few megabytes of features, whatever the corpus). Scoring is one pass over all whole
texts, without a shuffle.

Defined results: a null text is an empty one, and empty texts are scored like any other (features
0); labels that are null count for nothing, repeated labels count as often as they stand; without
labels every score is 0.5, with one class only the scores are all alike; repeated rows each get
their score; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemoor.llm.common import each_batch, query, table, texts_of
from lakemoor.sources.names import quote

MOST_LABELLED = 20_000  # rows that the model is fitted on
BINS = 48  # per feature
PAIR_BINS = 12  # per feature of a pair
PAIRS = 10
ROUNDS, PAIR_ROUNDS = 120, 40
RATE = 0.15
LEAST_WEIGHT = 2.0  # of the second derivatives on either side of a split
STRETCH = 400  # bytes

# Kinds of bytes, 16 bits of a sum for each.
_UPPER, _LETTER, _DIGIT, _MARK = 0, 16, 32, 48
_KIND = np.zeros(256, np.uint64)
for _byte in range(256):
    if 65 <= _byte <= 90:
        _KIND[_byte] += 1 << _UPPER
    if 65 <= _byte <= 90 or 97 <= _byte <= 122 or _byte >= 128:
        _KIND[_byte] += 1 << _LETTER
    if 48 <= _byte <= 57:
        _KIND[_byte] += 1 << _DIGIT
    if 33 <= _byte <= 126 and not chr(_byte).isalnum() and chr(_byte) not in ".,'\"-":
        _KIND[_byte] += 1 << _MARK

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "stops_and_commas", "spaces",
    "worst_upper", "worst_digits", "worst_marks", "mean_upper_stretch", "distinct_words", "repeated_next",
    "top_word", "worst_distinct", "lines", "line_length", "repeated_lines", "lone_marks", "long_words",
)


def features(text: str) -> list[float]:
    """One number per name in ``FEATURES``; all 0 for an empty text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = len(raw)
    sums = np.add.reduceat(_KIND[raw], np.arange(0, n, STRETCH))
    sizes = np.full(len(sums), STRETCH)
    sizes[-1] = n - STRETCH * (len(sums) - 1)
    kinds = ((sums[None, :] >> np.array([[_UPPER], [_LETTER], [_DIGIT], [_MARK]], np.uint64)) & np.uint64(0xFFFF)).astype(
        float
    )
    upper, letter, digit, mark = kinds.sum(axis=1)
    full = sizes >= min(STRETCH, n) * 0.5  # a short rest at the end tells little
    share = kinds[:, full] / sizes[full]
    upper_share = kinds[0, full] / np.maximum(kinds[1, full], 1)
    words = text.split()
    n_words = max(len(words), 1)
    distinct = len(set(words))
    top = Counter(words).most_common(1)[0][1] if words else 0
    windows = [words[at : at + 60] for at in range(0, max(len(words) - 30, 1), 60)]
    worst = min((len(set(one)) / max(len(one), 1) for one in windows), default=1.0)
    lines = text.split("\n")
    stops = text.count(".") + text.count(",")
    lone = sum(1 for word in words if len(word) <= 2 and not word[0].isalnum())
    return [
        np.log1p(n),
        np.log1p(len(words)),
        sum(map(len, words)) / n_words,
        upper / max(letter, 1),
        digit / n,
        mark / n,
        stops / n_words,
        (text.count(" ") + len(lines) - 1) / n,
        float(upper_share.max()),
        float(share[2].max()),
        float(share[3].max()),
        float(upper_share.mean()),
        distinct / n_words**0.8,
        sum(map(eq, words, words[1:])) / n_words,
        top / n_words,
        worst,
        np.log1p(len(lines)),
        np.log1p(len(text) / len(lines)),
        1 - len(set(lines)) / len(lines),
        lone / n_words,
        sum(1 for word in words if len(word) > 25) / n_words,
    ]


def feature_matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(text) for text in texts], float).reshape(len(texts), len(FEATURES))


@dataclass
class AdditiveModel:
    """Lookup tables: an entry per bin of each feature, and per pair of bins of some pairs."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for column, edges, entries in zip(x.T, self.edges, self.tables):
            out += entries[np.searchsorted(edges, column, side="right")]
        coarse = [np.searchsorted(edges, column, side="right") for column, edges in zip(x.T, self.pair_edges)]
        for i, j, entries in self.pairs:
            out += entries[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Quantiles between distinct values."""
    out = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))
        out.append(values)
    return out


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values per bin of a tree of at most ``leaves`` leaves over the ordered bins."""
    cuts = [0, len(g)]
    total_g, total_h = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(cuts) <= leaves:
        best, place = 1e-9, None
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            left_g, left_h = total_g[at] - total_g[a], total_h[at] - total_h[a]
            all_g, all_h = total_g[b] - total_g[a], total_h[b] - total_h[a]
            gain = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            gain[(left_h < LEAST_WEIGHT) | (all_h - left_h < LEAST_WEIGHT)] = 0
            if gain.max() > best:
                best, place = gain.max(), int(at[gain.argmax()])
        if place is None:
            break
        cuts = sorted([*cuts, place])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (total_g[b] - total_g[a]) / (total_h[b] - total_h[a] + 1.0)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both features once (four quarters)."""
    gg, hh = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        a, top, side, whole = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, top - a, side - a, whole - top - side + a]

    parts = list(zip(quarters(gg), quarters(hh)))
    gain = sum(_gain(a, b) for a, b in parts) - _gain(gg[-1, -1], hh[-1, -1])
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(g)
    spans = [(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
             (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))]
    for (a, b), (rows, columns) in zip(parts, spans):
        out[rows, columns] = a[i, j] / (b[i, j] + 1.0)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting on features ``x`` and labels ``y`` of 0 and 1."""
    if not len(y):
        return AdditiveModel(0.0)
    prior = np.clip(y.mean(), 0.01, 0.99)
    model = AdditiveModel(float(np.log(prior / (1 - prior))))
    if y.min() == y.max():
        return model
    model.edges, model.pair_edges = _edges(x, BINS), _edges(x, PAIR_BINS)
    bins = [np.searchsorted(edges, column, side="right") for column, edges in zip(x.T, model.edges)]
    sizes = [len(edges) + 1 for edges in model.edges]
    model.tables = [np.zeros(size) for size in sizes]
    margin = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, own in enumerate(bins):
            g, h = slopes()
            step = RATE * _shallow_tree(np.bincount(own, g, sizes[j]), np.bincount(own, h, sizes[j]))
            model.tables[j] += step
            margin += step[own]

    coarse = [np.searchsorted(edges, column, side="right") for column, edges in zip(x.T, model.pair_edges)]
    widths = [len(edges) + 1 for edges in model.pair_edges]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        at, shape = coarse[i] * widths[j] + coarse[j], (widths[i], widths[j])
        size = widths[i] * widths[j]
        return np.bincount(at, g, size).reshape(shape), np.bincount(at, h, size).reshape(shape)

    ranked = sorted(((-_cross(*grids(i, j))[0], i, j) for j in range(len(bins)) for i in range(j)))
    model.pairs = [(i, j, np.zeros((widths[i], widths[j]))) for gain, i, j in ranked[:PAIRS] if gain < 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, entries in model.pairs:
            step = RATE * _cross(*grids(i, j))[1]
            entries += step
            margin += step[coarse[i], coarse[j]]
    return model


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled rows that are not held out."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("quality").isin(0, 1) & (_remainder(F.col("doc_id")) != 1))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(most)
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = feature_matrix(batch.column("text").to_pylist())
        rows = pa.array(list(found), pa.list_(pa.float64()))
        names = ["doc_id", "quality", "hash"]
        return pa.record_batch([*map(batch.column, names), rows], names=[*names, "x"])

    # Broadcast: ``most`` rows of two numbers. A doc_id may stand in many rows, so they are bounded again.
    known = texts_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("hash"), "text")
    found = known.mapInArrow(each_batch(run), "doc_id long, quality int, hash long, x array<double>")
    rows = found.orderBy(F.xxhash64("doc_id", "hash"), "doc_id", "hash", "quality", "x").limit(most).collect()
    rows.sort(key=lambda row: (row.doc_id, row.quality, row.x))
    x = np.array([row.x for row in rows], float).reshape(len(rows), len(FEATURES))
    return x, np.array([row.quality for row in rows], float)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> AdditiveModel:
    return fit(*training_rows(docs, labels, most))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = model.score(feature_matrix(batch.column("text").to_pylist()))
        return pa.record_batch([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    scored = texts_of(docs).mapInArrow(each_batch(run), "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(_remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not reject."""

    def run(texts: pa.RecordBatch) -> pa.RecordBatch:
        found = ["" if text is None else text for text in texts.column(texts.num_columns - 1).to_pylist()]
        good = model.score(feature_matrix(found)) >= 0.5
        return texts.filter(pa.array(good))

    names = [*[name for name in docs.columns if name != "text"], "text"]
    # By number while Python sees them: it takes a point in a name for one of a struct.
    own = docs.select(*map(quote, names)).toDF(*[f"c{at}" for at in range(len(names))])
    kept = own.mapInArrow(each_batch(run), own.schema).toDF(*names)
    return kept.select(*map(quote, docs.columns))


@query()
def op6_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
