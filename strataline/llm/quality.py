"""Quality classifier (operator 3): gradient-boosted trees over document statistics.

The statistics of a batch come from one byte histogram per text and from its
word and line hashes.  The trees are grown on histograms of binned statistics
of a bounded sample of labelled documents, and flattened into arrays of
features, thresholds and children, which numpy walks for all documents at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import textkit as K
from strataline.llm.shared import crc_mod, table

SAMPLE_ROWS = 20_000
TREES = 80
DEPTH = 4
BINS = 48
RATE = 0.12

_MARKS = b"|%$#&*!?.,;:-_\"'()<>=+/\\@[]{}"
STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "newline", "other_ascii", "non_ascii",
    "distinct_words", "repeat_next", "top_word", "short_words", "long_words", "log_lines", "line_bytes", "distinct_lines", *(f"mark_{m}" for m in _MARKS),
]


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def _largest_count(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the count of the most frequent one, of each owner."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    tag = np.sort((keys >> np.uint64(20)) | (owner.astype(np.uint64) << np.uint64(44)))
    at = np.flatnonzero(np.r_[True, tag[1:] != tag[:-1]])
    own = (tag[at] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, own, np.diff(np.r_[at, len(tag)]).astype(float))
    return np.bincount(own, minlength=n).astype(float), most


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; an empty text has zeros."""
    n = len(bounds)
    ends = np.r_[bounds[1:], len(data)]
    size = (ends - bounds).astype(float)
    owner = np.repeat(np.arange(n), ends - bounds)
    hist = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    low, starts, stops, own = K.words(data, bounds)
    h = K.word_hashes(low, starts, stops)
    count = np.bincount(own, minlength=n).astype(float)
    length = (stops - starts).astype(float)
    distinct, top = _largest_count(h, own, n)
    again = np.r_[False, (h[1:] == h[:-1]) & (own[1:] == own[:-1])] if len(h) else np.zeros(0, bool)
    line_start, line_end, line_own = K.runs(data != 10, bounds)
    lines = np.bincount(line_own, minlength=n).astype(float)
    line_hash = K.span_hash(K.prefix_sums(K.byte_values(data)), line_start, line_end)
    distinct_lines, _ = _largest_count(line_hash, line_own, n)
    by = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    columns = [
        np.log1p(size), np.log1p(count), by(_sums(length, own, n), count), by(hist[:, 65:91].sum(1), size), by(hist[:, 48:58].sum(1), size),
        by(hist[:, 32], size), by(hist[:, 10], size), by(hist[:, :128].sum(1) - hist[:, 65:91].sum(1) - hist[:, 97:123].sum(1), size), by(hist[:, 128:].sum(1), size),
        by(distinct, count), by(_sums(again, own, n), count), by(top, count), by(_sums(length < 3, own, n), count), by(_sums(length > 12, own, n), count),
        np.log1p(lines), by(size, lines), by(distinct_lines, lines), *(by(hist[:, m], count) for m in _MARKS),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


class Trees:
    """Boosted trees flattened into arrays; a leaf is its own child."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value, self.roots, self.bias = [], [], [], [], [], [], 0.0

    def freeze(self) -> Trees:
        self.feature, self.left, self.right, self.roots = (np.array(x, np.int32) for x in (self.feature, self.left, self.right, self.roots))
        self.cut, self.value = np.array(self.cut, np.float32), np.array(self.value, np.float64)
        return self

    def score(self, x: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """Probability of label 1 of each row."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, np.int32)
            for _ in range(depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = 3.0) -> Trees:
    """Boosted trees for the logistic loss; splits are sought on histograms of binned columns."""
    model = Trees()
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model.bias = float(np.log(share / (1 - share)))
    if len(y) < 20 or share in (1e-3, 1 - 1e-3):
        return model.freeze()
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")).astype(np.float32) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
    width = bins + 1
    place = binned + np.arange(x.shape[1]) * width
    score = np.full(len(y), model.bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        model.roots.append(len(model.feature))
        open_ = [np.arange(len(y))]
        nodes = [_node(model)]
        for level in range(depth + 1):
            following, places = [], []
            for rows, node in zip(open_, nodes):
                g, h = grad[rows].sum(), hess[rows].sum()
                split = _best_split(place[rows], grad[rows], hess[rows], x.shape[1], width, ridge) if level < depth and len(rows) >= 20 else None
                if split is None:
                    model.value[node] = rate * g / (h + ridge)
                    score[rows] += model.value[node]
                    continue
                feature, at = split
                goes = binned[rows, feature] <= at
                model.feature[node], model.cut[node] = feature, cuts[feature][at]
                model.left[node], model.right[node] = _node(model), _node(model)
                following += [rows[goes], rows[~goes]]
                places += [model.left[node], model.right[node]]
            open_, nodes = following, places
    return model.freeze()


def _node(model: Trees) -> int:
    at = len(model.feature)
    for column, value in ((model.feature, 0), (model.cut, 0.0), (model.left, at), (model.right, at), (model.value, 0.0)):
        column.append(value)
    return at


def _best_split(place: np.ndarray, grad: np.ndarray, hess: np.ndarray, features: int, width: int, ridge: float) -> tuple[int, int] | None:
    flat = place.ravel()
    g = np.bincount(flat, weights=np.repeat(grad, features), minlength=features * width).reshape(features, width).cumsum(axis=1)
    h = np.bincount(flat, weights=np.repeat(hess, features), minlength=features * width).reshape(features, width).cumsum(axis=1)
    all_g, all_h = g[:, -1:], h[:, -1:]
    gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
    gain[(h < 1) | (all_h - h < 1)] = 0
    best = int(gain.argmax())
    return None if gain.flat[best] <= 1e-3 else (best // width, best % width)


def sampled_labels(labels: DataFrame, label: str, folds: list[int], modulus: int = 5, doc_id: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` labelled ids of the given folds, chosen by a hash of the id.

    An id with several labels has the largest.  The bound makes the result small
    enough to broadcast.
    """
    named = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    named = named.where(crc_mod(F.col("doc_id"), modulus).isin(folds)).groupBy("doc_id").agg(F.max("label").alias("label"))
    return named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _statistics_rows(batches):
    for batch in batches:
        data, offsets, _ = K.column_bytes(batch.column("text"))
        for a, b in K.pieces(offsets):
            x = statistics(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], ["label", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: tuple[int, ...] = (1, 2, 3, 4), rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted to at most `rows` labelled documents of the given folds of crc32(doc_id) mod 5.

    Without labels, or with a single class, every score is the share of label 1.
    """
    sample = sampled_labels(labels, label, list(folds), rows=rows).collect()
    spark = docs.sparkSession
    named = spark.createDataFrame([(r.doc_id, r.label) for r in sample], "doc_id long, label int")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(named), "doc_id")
    got = texts.select("label", "text").mapInArrow(_statistics_rows, "label int, x array<float>").toArrow()
    y = np.asarray(got.column("label").combine_chunks()).astype(float) if got.num_rows else np.zeros(0)
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(len(y), len(STATISTICS)) if len(y) else np.zeros((0, len(STATISTICS)), np.float32)
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, int)  # the fit does not depend on the order of rows
    return grow(x[order], y[order])


def score_quality(docs: DataFrame, model: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            data, offsets, _ = K.column_bytes(batch.column("text"))
            out = [shared.value.score(statistics(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a])) for a, b in K.pieces(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([np.zeros(0), *out]))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, "doc_id long, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's scores; a row with a null id belongs to no held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
