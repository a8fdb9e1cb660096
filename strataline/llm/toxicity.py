"""Toxicity (operator 6): class-conditional Kneser-Ney models of toxic and of ordinary text.

What is scored is a logistic reading of five figures of a text: the difference
of its two log-likelihoods normalised by its length, the same by the root of
its length, over its worst passage, its peaks, and its length.  The reading is
fitted to labelled documents that the models did not count.

Word bigrams are counted in labelled texts of each class.  Both models back off
to continuation counts of their class, and these to one distribution that the
classes share: the counts of the words over the whole corpus.

The class models count every labelled document of their folds, and the reading
is fitted to every one of its folds, by Newton steps whose sums come from the
tasks.  Words that the counted documents have twice or more are the vocabulary;
the others share one entry, by which a class is told how likely a rare word is after the
word before.  Which rare word it is, the shared counts tell, alike for both
classes, so that cancels in their ratio.  (Rare words with entries of their own
were tried: a word that one class has once becomes a peak of its own, and the
AUC on sf0.1 falls from 0.972 to 0.917.)  Every pair counts, those seen once
too.  The shared counts cover every word of every document.

The tasks get the frequent words and their pairs: words that make up SHARE of the
counted ones, so that what is left over grows with the input, and of those as
many as have MOST_PAIRS pairs.  What all models say of the pairs of the other
words lies in a table in the shared folder, and is looked up by a join; the
figures of single words go to the tasks for MOST_WORDS words and are looked up
beyond.  These bounds move work between the two ways and change no score.

A text whose words are looked up is kept as its sums over cells of CELL words, so
no text is shuffled: the worst passage is one of whole cells.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strataline.llm import textkit as K
from strataline.llm.shared import crc_mod, discard, fresh, settle, table

MOST_WORDS = 1 << 20
MOST_PAIRS = 6_000_000
SHARE = 4e-6
#: Labels that are sent at once; more go in blocks, each with a scan of its documents, so that no text is shuffled.
LABEL_BLOCK = 1 << 21
PASSAGE_WORDS = 40
CELL = 8
#: Texts are looked up in that many turns, each of which leaves nothing but figures.
TURNS = 4
#: Of 64 bits each, in the filter of the pairs that are looked up.
SLOTS = 1 << 21
_PACKED = 1 << 18
_BEGIN = 1  # vocabulary numbers: 0 is any unknown word, 1 the start of a text
_FAR = -(1 << 63)  # numbers of words that a vocabulary has not are their hashes, made negative


class Vocabulary:
    def __init__(self, keys: np.ndarray):
        self.table = K.PackedTable(np.unique(keys))
        self.size = len(self.table.keys) + 2

    def numbers(self, data: np.ndarray, bounds: np.ndarray, far: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's number, the number before it, and its text; with `far` the words that are not here have numbers too."""
        low, starts, ends, owner = K.words(data, bounds)
        keys = K.word_hashes(low, starts, ends)
        word = self.table.find(keys).astype(np.int64) + 2
        word[word == 1] = (keys.view(np.int64) | _FAR)[word == 1] if far else 0
        before = np.r_[_BEGIN, word[:-1]][: len(word)]
        before[1:][owner[1:] != owner[:-1]] = _BEGIN
        return word, before, owner


def _each(batches, function, names):
    for batch in batches:
        data, offsets, _ = K.column_bytes(batch.column("text"))
        label = np.asarray(batch.column("label")) if "label" in batch.schema.names else None
        for a, b in K.pieces(offsets):
            out = function(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], None if label is None else label[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)


def _words(batches):
    def count(data, bounds, label):
        low, starts, ends, _ = K.words(data, bounds)
        keys, n = np.unique(K.word_hashes(low, starts, ends), return_counts=True)
        return keys.view(np.int64), n

    yield from _each(batches, count, ["key", "n"])


def _pair_counts(shared, far=False):
    """Counts in both classes of (number before, number)."""

    def run(batches):
        def count(data, bounds, label):
            word, before, owner = shared.value.numbers(data, bounds, far)
            kinds = np.unique(np.r_[word, before]) if far else None
            if far:
                word, before = np.searchsorted(kinds, word), np.searchsorted(kinds, before)
            key, n = np.unique((label[owner].astype(np.int64) << 62) | (before << 31) | word, return_counts=True)
            ends = [(key >> 31) & 0x7FFFFFFF, key & 0x7FFFFFFF]
            return *(kinds[x] if far else x for x in ends), np.where(key < 1 << 62, n, 0), np.where(key < 1 << 62, 0, n)

        yield from _each(batches, count, ["before", "word", "n0", "n1"])

    return run


def _ends(batch):
    return np.asarray(batch.column("before")), np.asarray(batch.column("word"))


def _levels(commons):
    """How many pairs, of both classes, have a less common word of each count; the shared entries count as common."""

    def run(batches):
        for batch in batches:
            before, word = (np.maximum(x, 0) for x in _ends(batch))
            seen = (np.asarray(batch.column("n0")) > 0).astype(np.int64) + (np.asarray(batch.column("n1")) > 0)
            level, at = np.unique(np.minimum(commons.value[before], commons.value[word]), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(np.bincount(at, weights=seen, minlength=len(level)).astype(np.int64))], ["level", "n"])

    return run


def _renumbered(numbers):
    """The same counts under the numbers of a smaller vocabulary."""

    def run(batches):
        for batch in batches:
            ends = [pa.array(numbers.value[np.maximum(x, 0)]) for x in _ends(batch)]
            yield pa.RecordBatch.from_arrays([*ends, batch.column("n0"), batch.column("n1")], ["before", "word", "n0", "n1"])

    return run


def least_count(levels: np.ndarray, n: np.ndarray, most: int, beside=lambda level: 0) -> int:
    """The smallest level, 2 at least, so that those at it or above are `most` at most, with what comes beside them."""
    order = np.argsort(levels)
    levels, n = levels[order], n[order]
    left = np.cumsum(n[::-1])[::-1]
    for level, above in zip(levels, left):
        if above + beside(level) <= most:
            return max(2, int(level))
    return int(levels[-1]) + 1 if len(levels) else 2


def _corpus_counts(shared):
    def run(batches):
        total = np.zeros(shared.value.size, np.int64)
        for batch in batches:
            data, offsets, _ = K.column_bytes(batch.column("text"))
            for a, b in K.pieces(offsets):
                word, _, _ = shared.value.numbers(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a])
                total += np.bincount(word, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["w", "n"])

    return run


def _far_words(shared):
    def run(batches):
        def count(data, bounds, label):
            word, _, _ = shared.value.numbers(data, bounds, far=True)
            return np.unique(word[word < 0], return_counts=True)

        yield from _each(batches, count, ["id", "n"])

    return run


class PairCounts:
    """Sorted pairs of one class with their counts, in nine bytes a pair; counts of 255 and more stand apart."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, np.minimum(n, 255).astype(np.uint8)
        self.large_at = np.flatnonzero(n >= 255)
        self.large = n[self.large_at].astype(np.int64)

    def __reduce__(self):
        cuts = range(0, len(self.keys), _PACKED)
        parts = [pa.compress(np.diff(self.keys[k : k + _PACKED]).tobytes(), "zstd", asbytes=True) for k in cuts]
        return PairCounts._read, (len(self.keys), self.keys[::_PACKED].copy(), parts, pa.compress(self.n.tobytes(), "zstd", asbytes=True), self.large_at, self.large)

    @staticmethod
    def _read(size: int, first: np.ndarray, parts: list[bytes], n: bytes, large_at: np.ndarray, large: np.ndarray) -> PairCounts:
        out = PairCounts.__new__(PairCounts)
        out.keys = np.empty(size, np.int64)
        for k, part in enumerate(parts):  # a part at a time, so that little is held twice
            here = out.keys[k * _PACKED : (k + 1) * _PACKED]
            here[0] = first[k]
            if len(here) > 1:
                np.cumsum(np.frombuffer(pa.decompress(part, (len(here) - 1) * 8, "zstd", asbytes=True), np.int64), out=here[1:])
            here[1:] += first[k]
        out.n = np.frombuffer(pa.decompress(n, size, "zstd", asbytes=True), np.uint8)
        out.large_at, out.large = large_at, large
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Counts of the given keys, which are best sorted; 0 where a pair is absent."""
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out = np.where(self.keys[at] == keys, self.n[at], 0).astype(float)
        full = np.flatnonzero(out == 255)
        out[full] = self.large[np.searchsorted(self.large_at, at[full])]
        return out


def discount(n: np.ndarray) -> float:
    """The Kneser-Ney discount of counts n, from how many are one and two."""
    return _discount(float((n == 1).sum()), float((n == 2).sum()))


def _discount(once: float, twice: float) -> float:
    return once / (once + 2 * twice) if once else 0.5


class ClassModels:
    """Interpolated Kneser-Ney bigram models of both classes over one shared lowest order."""

    def __init__(self, vocabulary: Vocabulary, corpus: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]):
        """corpus: count of each word number; pairs: of each class the keys (before << 31 | word), sorted, and their counts."""
        self.vocabulary = vocabulary
        size = vocabulary.size
        base = (corpus + 0.5) / (corpus.sum() + 0.5 * size)
        self.pairs, self.cut = [], np.zeros(2)
        self.gain, self.low, self.mass = np.ones((2, size), np.float32), np.zeros((2, size), np.float32), np.ones((2, size), np.float32)
        for c, (keys, n) in enumerate(pairs):
            self.pairs.append(PairCounts(keys, n))
            self.cut[c] = cut = discount(n)
            before, word = keys >> 31, keys & 0x7FFFFFFF
            mass = np.bincount(before, weights=n, minlength=size)
            self.mass[c] = np.maximum(mass, 1)
            self.gain[c] = np.where(mass > 0, cut * np.bincount(before, minlength=size) / self.mass[c], 1)  # cut is at most 1, and so is each count at least
            spread = np.bincount(word, minlength=size).astype(float)
            kinds, total, cut = (spread > 0).sum(), max(1.0, spread.sum()), discount(spread)
            self.low[c] = np.maximum(spread - cut, 0) / total + (cut * kinds / total if kinds else 1.0) * base

    def likelihoods(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability of each word after the one before it, in both classes."""
        keys, at = np.unique((before << 31) | word, return_inverse=True)
        seen = np.stack([np.maximum(p.find(keys) - cut, 0)[at] for p, cut in zip(self.pairs, self.cut)])
        return seen / self.mass[:, before] + self.gain[:, before] * self.low[:, word]

    def features(self, data: np.ndarray, bounds: np.ndarray, passage: int = PASSAGE_WORDS) -> np.ndarray:
        """Length-normalised log-likelihood ratios of each text; an empty text has zeros."""
        word, before, owner = self.vocabulary.numbers(data, bounds)
        return _features(*_cells(self.ratio(before, word), owner, len(bounds)), passage)

    def ratio(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        p = self.likelihoods(before, word)
        return np.log(p[1]) - np.log(p[0])

    def take(self, whole: Figures, numbers: np.ndarray) -> None:
        """Put the figures of a larger vocabulary in place of those of this one, which knows its words by the given numbers there."""
        self.cut = whole.cut
        self.gain, self.low, self.mass = (x[:, numbers] for x in (whole.gain, whole.low, whole.mass))


class Figures:
    """What both classes make of single words: the discount of pairs, and of each word its mass and gain before others and its share after others."""

    def __init__(self, cut: np.ndarray, mass: np.ndarray, gain: np.ndarray, low: np.ndarray):
        self.cut, self.mass, self.gain, self.low = cut, mass.astype(np.float32), gain.astype(np.float32), low.astype(np.float32)

    def ratio(self, before: np.ndarray, word: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        """The log-likelihood ratio of pairs with the given counts n (2 x pairs), or with none."""
        return _ratio(self.cut, self.mass[:, before], self.gain[:, before], self.low[:, word], n)


def _ratio(cut, mass, gain, low, n=None):
    p = gain.astype(float) * low
    if n is not None:
        p = p + np.maximum(n - cut[:, None], 0) / mass
    return np.log(p[1]) - np.log(p[0])


def _peak(ratio: np.ndarray) -> np.ndarray:
    return np.maximum(ratio, 0) ** 2


def _cells(ratio: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and peaks of each text, the sums of its cells, and the bounds of these."""
    n = np.bincount(owner, minlength=texts)
    cells = np.r_[0, np.cumsum(-(-n // CELL))]
    return n, np.bincount(owner, weights=_peak(ratio), minlength=texts), np.bincount(_cell_of(owner, n, cells), weights=ratio, minlength=cells[-1]), cells


def _cell_of(owner: np.ndarray, n: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return cells[owner] + (np.arange(len(owner)) - (np.cumsum(n) - n)[owner]) // CELL


def _features(n: np.ndarray, peaks: np.ndarray, sums: np.ndarray, cells: np.ndarray, passage: int = PASSAGE_WORDS) -> np.ndarray:
    owner = np.repeat(np.arange(len(n)), np.diff(cells))
    total = np.bincount(owner, weights=sums, minlength=len(n))
    upto = np.r_[0, np.cumsum(sums)]
    start = np.maximum(np.arange(len(sums)) + 1 - passage // CELL, cells[owner])
    worst = np.zeros(len(n))
    np.maximum.at(worst, owner, upto[1:] - upto[start])
    size = np.maximum(n, 1).astype(float)
    return np.stack([total / size, total / np.sqrt(size), worst / passage, np.sqrt(np.maximum(peaks, 0) / size), np.log1p(n)], axis=1)


class Rest:
    """What a task must know of the words that are not in the models: their numbers, their pairs with unknown words, and which of their other pairs may have been counted."""

    def __init__(self, vocabulary: Vocabulary, number: np.ndarray, after: np.ndarray, ahead: np.ndarray, slots: np.ndarray, far: bool):
        """number: in the models, 0 where a word is not there; after, ahead: ratios after and ahead of an unknown word; far: there are counted words beside these."""
        self.vocabulary, self.number, self.after, self.ahead, self.slots, self.far = vocabulary, number, after, ahead, slots, far

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        bit = _bits(keys, len(self.slots))
        return (self.slots[bit >> 6] >> (bit & 63)) & 1 == 1


def _bits(keys: np.ndarray, slots: int) -> np.ndarray:
    return (K.mix(keys.view(np.uint64)) % np.uint64(64 * slots)).astype(np.int64)


def _filter(slots):
    """The bits of pairs, 64 in a slot."""

    def run(batches):
        for batch in batches:
            bit = np.unique(_bits(np.asarray(batch.column("key")), slots))
            slot, first = np.unique(bit >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.left_shift(np.int64(1), bit & 63), first) if len(bit) else bit
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bits)], ["slot", "bits"])

    return run


def _gains(figures, number):
    """What the counts of a pair that the models have not add to the ratio and the peaks of a text."""

    def run(batches):
        for batch in batches:
            before, word = _ends(batch)
            at = (number.value[before] == 0) | (number.value[word] == 0)
            before, word = before[at], word[at]
            n = np.stack([np.asarray(batch.column(c))[at] for c in ("n0", "n1")])
            ratio, plain = figures.value.ratio(before, word, n), figures.value.ratio(before, word)
            yield pa.RecordBatch.from_arrays([pa.array((before << 31) | word), pa.array((ratio - plain).astype(np.float32)), pa.array((_peak(ratio) - _peak(plain)).astype(np.float32))], ["key", "delta", "peak"])

    return run


_READ = "n long, peaks double, cells array<float>, asked array<struct<at: int, key: long>>, far array<struct<at: int, before: long, word: long, plain: double>>"


def _read(models, figures, rest, carry):
    """A text by its words, peaks and cells, as far as the broadcasts tell, and what is to be looked up in which cell."""

    def lists(bounds, fields):
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields)))

    def run(batches):
        m, f, r = models.value, figures.value, rest.value
        for batch in batches:
            data, offsets, _ = K.column_bytes(batch.column("text"))
            for a, b in K.pieces(offsets):
                word, before, owner = r.vocabulary.numbers(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], r.far)
                w, v = np.maximum(word, 0), np.maximum(before, 0)
                ratio = np.where(v == 0, r.after[w], r.ahead[v]).astype(float)
                inside = (r.number[w] > 0) & (r.number[v] > 0)
                ratio[inside] = m.ratio(r.number[v[inside]], r.number[w[inside]])
                other = np.flatnonzero(~inside & (v > 0) & (w > 0))
                ratio[other] = f.ratio(v[other], w[other])
                key = (v[other] << 31) | w[other]
                hit = r.maybe(key)
                other, key = other[hit], key[hit]
                away = np.flatnonzero((word < 0) | (before < 0))
                n, peaks, sums, cells = _cells(ratio, owner, b - a)
                at = (_cell_of(owner, n, cells) - cells[owner]).astype(np.int32)
                split = lambda x: np.searchsorted(owner[x], np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in carry), pa.array(n), pa.array(peaks), pa.ListArray.from_arrays(pa.array(cells.astype(np.int32)), pa.array(sums.astype(np.float32))),
                     lists(split(other), {"at": at[other], "key": key}), lists(split(away), {"at": at[away], "before": before[away], "word": word[away], "plain": ratio[away]})],
                    [*carry, "n", "peaks", "cells", "asked", "far"],
                )

    return run


def _finish(carry):
    """The figures of texts, with what was looked up."""

    def run(batches):
        for batch in batches:
            cells, sums = np.asarray(batch.column("cells").offsets).astype(np.int64), np.asarray(batch.column("cells").flatten(), dtype=float)
            cells = cells - cells[0]
            size = np.asarray(batch.column("at").value_lengths().fill_null(0)).astype(np.int64)
            at, delta, peak = (np.asarray(batch.column(c).flatten()) for c in ("at", "delta", "peak"))
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((peak, delta, at, owner))  # equal texts have equal sums
            at, delta, peak, owner = at[order], delta[order].astype(float), peak[order].astype(float), owner[order]
            sums = sums + np.bincount(cells[owner] + at, weights=delta, minlength=len(sums))
            peaks = np.asarray(batch.column("peaks")) + np.bincount(owner, weights=peak, minlength=len(size))
            x = _features(np.asarray(batch.column("n")), peaks, sums, cells)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *(pa.array(x[:, k]) for k in range(5))], [*carry, *"abcde"])

    return run


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([z, z[:, :4] * z[:, 4:], np.ones((len(z), 1))], axis=1)


@dataclass
class Lookups:
    """The part of the models that is looked up: pairs(key, delta, peak), and of words that no task is told words(id, figures) and far(before, word, n0, n1)."""

    figures: Broadcast
    rest: Broadcast
    pairs: DataFrame
    words: DataFrame | None = None
    far: DataFrame | None = None


class Reading:
    """A logistic reading of the five figures of a text and their products with its length."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (_design(x, self.mean, self.scale) * self.weights).sum(axis=1)  # row by row, so that no score depends on its neighbours
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class ToxicityModel:
    """Class models, shared with the tasks, what is looked up beside them, and the reading of both."""

    models: Broadcast
    reading: Reading
    lookups: Lookups | None = None


def _reading(figures: DataFrame, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) of a logistic regression of all rows (label, a .. e), by Newton steps; the last weight is the constant.

    A step takes one row of sums from each task.
    """
    size = 10
    got = figures.agg(F.count("*"), F.avg("label"), *(f(c) for f in (F.avg, F.stddev_pop) for c in "abcde")).first()
    w = np.zeros(size)
    if not got[0]:
        return np.zeros(5), np.ones(5), w
    share, mean, scale = got[1], np.array(got[2:7]), np.array(got[7:12]) + 1e-9
    held = min(max(share, 1e-3), 1 - 1e-3)
    w[-1] = np.log(held / (1 - held))
    if share in (0, 1):
        return mean, scale, w
    damp = np.full(size, ridge)

    def sums(w):
        def run(batches):
            total = np.zeros(size + size * size)
            for batch in batches:
                x = _design(np.stack([np.asarray(batch.column(c)) for c in "abcde"], axis=1), mean, scale)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
                total[:size] += x.T @ (np.asarray(batch.column("label")) - p)
                total[size:] += ((x * (p * (1 - p) + 1e-6)[:, None]).T @ x).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        rows = sorted(tuple(r.sums) for r in figures.mapInArrow(run, "sums array<double>").collect())
        total = np.array(rows).sum(axis=0)
        return total[:size], total[size:].reshape(size, size)

    for _ in range(60):
        gradient, curve = sums(w)
        step = np.linalg.solve(curve + np.diag(damp), gradient - damp * w)
        w = w + step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", count_folds: tuple[int, ...] = (2, 3, 4), reading_folds: tuple[int, ...] = (1,)) -> ToxicityModel:
    """Models counted in one part of the labelled documents and read on another, each in all of its documents.

    The folds are those of crc32(doc_id) mod 5.  Without any labelled document
    every score is 0.5, or the share of label 1.  The driver and the broadcasts
    get at most MOST_WORDS words and about MOST_PAIRS pairs, some ten bytes a
    pair; the rest is looked up.  Repeated rows count again; texts that are null, empty or without
    words count nothing.  Of several labels of an id the largest holds.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = labels.select(F.col(doc_id).cast("long").alias("doc_id"), (F.col(label).cast("int") > 0).cast("int").alias("label")).where("doc_id is not null and label is not null")

    def texts(folds):
        inside = crc_mod(F.col("doc_id"), 5).isin(list(folds))
        named = marked.where(inside).groupBy("doc_id").agg(F.max("label").alias("label"))
        blocks = max(1, -(-named.count() // LABEL_BLOCK))
        block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks))
        each = [plain.where(inside & (block == k)).join(F.broadcast(named.where(block == k)), "doc_id") for k in range(blocks)]
        return functools.reduce(DataFrame.unionByName, each).select("text", "label")

    train = texts(count_folds)
    words = _settle(train.mapInArrow(_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 2"), "toxic-words")
    spread = words.groupBy("n").count().toArrow()
    of, size = _column(spread, "n"), _column(spread, "count")
    told = least_count(of, size, MOST_WORDS)
    known = words.where(F.col("n") >= told).toArrow()
    key, n = _column(known, "key").view(np.uint64), _column(known, "n")
    order = np.argsort(key)
    key, n = key[order], n[order]
    shared = spark.sparkContext.broadcast(Vocabulary(key))
    beyond = words.where(F.col("n") < told).select(F.col("key").bitwiseOR(F.lit(_FAR)).alias("id")) if (of < told).any() else None
    pairs = _pairs(train.mapInArrow(_pair_counts(shared, beyond is not None), _PAIRS))
    if beyond is not None:
        beyond = _settle(beyond, "toxic-far-words")
        for end in ("before", "word"):
            real = beyond.select(F.col("id").alias(end), F.lit(True).alias("real"))
            pairs = pairs.join(real, end, "left").withColumn(end, F.when((F.col(end) >= 0) | F.col("real"), F.col(end)).otherwise(0)).drop("real")
        pairs = _pairs(pairs)
    pairs = _settle(pairs, "toxic-pairs")
    discard(words)
    seen = pairs.agg(*(F.count_if(c) for k in ("n0", "n1") for c in (F.col(k) == 1, F.col(k) == 2, F.col(k) > 0))).first()
    least = max(told, int(np.ceil(SHARE * float((of * size).sum()))))
    if seen[2] + seen[5] > MOST_PAIRS:
        common = spark.sparkContext.broadcast(np.r_[[np.iinfo(np.int64).max] * 2, n])
        levels = pairs.mapInArrow(_levels(common), "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).toArrow()
        # at most four pairs a word, two of each class, with the shared entry
        least = max(least, least_count(_column(levels, "level"), _column(levels, "n"), MOST_PAIRS, lambda level: 4 * int((n >= level).sum())))
    numbers = np.r_[0, _BEGIN, np.where(n >= least, np.cumsum(n >= least) + 1, 0)].astype(np.int64)
    whole = beyond is None and bool((numbers[1:] > 0).all())
    counted = pairs if whole else _pairs(pairs.mapInArrow(_renumbered(spark.sparkContext.broadcast(numbers)), _PAIRS))
    counted = pairs if whole else _settle(counted, "toxic-told")
    classes = []
    for c in ("n0", "n1"):  # one after the other, so that the driver holds little twice
        some = counted.where(F.col(c) > 0).select(F.shiftleft("before", 31).bitwiseOR(F.col("word")).alias("key"), F.col(c).cast("int").alias("n")).toArrow()
        order = np.argsort(_column(some, "key"))
        classes.append((_column(some, "key")[order], _column(some, "n")[order]))
        del some, order
        pa.default_memory_pool().release_unused()
    if not whole:
        discard(counted)
    corpus = np.zeros(len(numbers))
    all_ = _taken(plain.select("text").mapInArrow(_corpus_counts(shared), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "toxic-corpus")
    corpus[_column(all_, "w")] = _column(all_, "n")
    del all_
    lookups = None
    if whole:
        models = ClassModels(shared.value, corpus, classes)
        del classes
    else:
        models = ClassModels(Vocabulary(key[n >= least]), np.bincount(numbers, weights=corpus), classes)
        del classes
        lookups, figures = _lookups(plain, shared, numbers, pairs, seen, corpus, beyond)
        models.take(figures, np.r_[0, _BEGIN, np.flatnonzero(n >= least) + 2])
    discard(pairs)
    del key, n
    shared.unpersist()
    loaded = spark.sparkContext.broadcast(models)
    models = None  # the driver needs them no more
    pa.default_memory_pool().release_unused()
    figures = _settle(_figures(texts(reading_folds), loaded, lookups), "toxic-figures")
    reading = _reading(figures)
    discard(figures)
    return ToxicityModel(loaded, Reading(*reading), lookups)


_PAIRS = "before long, word long, n0 long, n1 long"


def _pairs(counts: DataFrame) -> DataFrame:
    return counts.groupBy("before", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _settle(df: DataFrame, name: str) -> DataFrame:
    """settle; what it shuffled goes as soon as the table stands."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return settle(df, name)
    finally:
        conf.set(key, before)


def _taken(df: DataFrame, name: str) -> pa.Table:
    """The rows of a bounded table, settled before so that nothing shuffled is left."""
    settled = _settle(df, name)
    out = settled.toArrow()
    discard(settled)
    return out


def _lookups(plain: DataFrame, shared: Broadcast, numbers: np.ndarray, pairs: DataFrame, seen: Row, corpus: np.ndarray, beyond: DataFrame | None) -> tuple[Lookups, Figures]:
    """What is looked up, and the figures of all words of the vocabulary `shared`; numbers are those of its words in the models."""
    spark = plain.sparkSession
    size = len(numbers)
    after = _settle(pairs.groupBy("before").agg(*(f for c in ("n0", "n1") for f in (F.sum(c).alias(f"mass_{c}"), F.count_if(F.col(c) > 0).alias(f"kinds_{c}")))), "toxic-after")
    into = _settle(pairs.groupBy("word").agg(*(F.count_if(F.col(c) > 0).alias(f"into_{c}") for c in ("n0", "n1"))), "toxic-into")
    words = None
    if beyond is not None:
        found = plain.select("text").mapInArrow(_far_words(shared), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        words = _settle(beyond.join(found, "id"), "toxic-far-counts")
        far, there = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    else:
        far = there = 0
    every = corpus.sum() + 0.5 * (size + far)
    base = (np.r_[corpus[0] - there, corpus[1:]] + 0.5) / every
    a, i = after.where("before >= 0").toArrow(), into.where("word >= 0").toArrow()
    mass, gain, low = (np.zeros((2, size)) for _ in range(3))
    cut, far_figures = np.zeros(2), []
    once = into.agg(*(F.count_if(c) for k in ("into_n0", "into_n1") for c in (F.col(k) == 1, F.col(k) == 2, F.col(k) > 0))).first()
    for c, name in enumerate(("n0", "n1")):
        cut[c] = _discount(*seen[3 * c : 3 * c + 2])
        kinds, spread = np.zeros(size), np.zeros(size)
        mass[c, _column(a, "before")], kinds[_column(a, "before")] = _column(a, f"mass_{name}"), _column(a, f"kinds_{name}")
        spread[_column(i, "word")] = _column(i, f"into_{name}")
        gain[c] = np.where(mass[c] > 0, cut[c] * kinds / np.maximum(mass[c], 1), 1)
        less, total = _discount(*once[3 * c : 3 * c + 2]), max(1.0, float(seen[3 * c + 2]))
        spare = less * once[3 * c + 2] / total if once[3 * c + 2] else 1.0
        low[c] = np.maximum(spread - less, 0) / total + spare * base
        m = F.coalesce(F.col(f"mass_{name}"), F.lit(0))
        far_figures += [
            F.greatest(m, F.lit(1)).cast("double").alias(f"mass{c}"),
            F.when(m > 0, F.lit(float(cut[c])) * F.col(f"kinds_{name}") / m).otherwise(1.0).alias(f"gain{c}"),
            (F.greatest(F.coalesce(F.col(f"into_{name}"), F.lit(0)) - F.lit(float(less)), F.lit(0.0)) / total + F.lit(float(spare)) * (F.col("n") + 0.5) / every).alias(f"low{c}"),
        ]
    figures = Figures(cut, np.maximum(mass, 1), gain, low)
    with_unknown = pairs.where("before >= 0 and word >= 0 and (before = 0 or word = 0)").toArrow()
    v, w, n = _column(with_unknown, "before"), _column(with_unknown, "word"), np.stack([_column(with_unknown, c) for c in ("n0", "n1")])
    every_word, none = np.arange(size), np.zeros(size, np.int64)
    first, second = figures.ratio(none, every_word), figures.ratio(every_word, none)
    first[w[v == 0]] = figures.ratio(v[v == 0], w[v == 0], n[:, v == 0])
    second[v[w == 0]] = figures.ratio(v[w == 0], w[w == 0], n[:, w == 0])
    told = spark.sparkContext.broadcast(figures)
    table = _settle(pairs.where("before > 0 and word > 0").mapInArrow(_gains(told, spark.sparkContext.broadcast(numbers)), "key long, delta float, peak float"), "toxic-rest")
    got, slots = _taken(table.select("key").mapInArrow(_filter(SLOTS), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")), "toxic-filter"), np.zeros(SLOTS, np.int64)
    slots[_column(got, "slot")] = _column(got, "bits")
    rest = spark.sparkContext.broadcast(Rest(shared.value, numbers, first.astype(np.float32), second.astype(np.float32), slots, beyond is not None))
    out = Lookups(told, rest, table)
    del a, i, with_unknown, got, slots, first, second
    if beyond is not None:
        joined = words.join(after.withColumnRenamed("before", "id"), "id", "left").join(into.withColumnRenamed("word", "id"), "id", "left")
        out.words = _settle(joined.select("id", *far_figures), "toxic-far-figures")
        out.far = _settle(pairs.where("before < 0 or word < 0"), "toxic-far-pairs")
        discard(words)
        discard(beyond)
    for spent in (after, into):
        discard(spent)
    return out, figures


def _figures(texts: DataFrame, models: Broadcast, lookups: Lookups | None) -> DataFrame:
    """The columns of texts besides `text`, and the five figures a .. e of each text."""
    carry = [c for c in texts.columns if c != "text"]
    kinds = "".join(f"{c} {kind}, " for c, kind in texts.dtypes if c != "text")
    schema = f"{kinds}a double, b double, c double, d double, e double"
    if lookups is None:

        def features(batches):
            for batch in batches:
                data, offsets, _ = K.column_bytes(batch.column("text"))
                for a, b in K.pieces(offsets):
                    x = models.value.features(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in carry), *(pa.array(x[:, k]) for k in range(5))], [*carry, *"abcde"])

        return texts.mapInArrow(features, schema)
    read = _settle(texts.mapInArrow(_read(models, lookups.figures, lookups.rest, carry), kinds + _READ).withColumn("row", F.monotonically_increasing_id()), "toxic-read")
    out = []
    for turn in range(TURNS):
        part = read.where(F.pmod("row", F.lit(TURNS)) == turn)
        found = part.select("row", F.inline("asked")).join(lookups.pairs, "key").select("row", "at", "delta", "peak")
        if lookups.far is not None:
            found = found.unionByName(_far_found(part, lookups))
        found = found.groupBy("row").agg(*(F.collect_list(c).alias(c) for c in ("at", "delta", "peak")))  # no value is null, so the lists go together
        here = part.join(found, "row", "left").select(*carry, "n", "peaks", "cells", "at", "delta", "peak")
        out.append(_settle(here.mapInArrow(_finish(carry), schema), "toxic-turn"))
    discard(read)
    return functools.reduce(DataFrame.unionByName, out)


def _far_found(part: DataFrame, lookups: Lookups) -> DataFrame:
    """(row, at, delta, peak) of places with a word that no task is told, where it was counted; else it is unknown, as it was read."""
    asked = part.select("row", F.inline("far"))
    for end in ("before", "word"):
        figures = lookups.words.select(F.col("id").alias(end), F.struct(*(c for c in lookups.words.columns if c != "id")).alias(f"{end}_has"))
        asked = asked.join(figures, end, "left").withColumn(end, F.when((F.col(end) >= 0) | F.col(f"{end}_has").isNotNull(), F.col(end)).otherwise(0))
    asked = asked.where("before < 0 or word < 0").join(lookups.far, ["before", "word"], "left")
    flat = [F.coalesce(F.col(f"{end}_has.{k}"), F.lit(0.0)).alias(k) for end, ks in (("before", ("mass0", "mass1", "gain0", "gain1")), ("word", ("low0", "low1"))) for k in ks]
    asked = asked.select("row", "at", "before", "word", "plain", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n0", "n1")), *flat)
    shared = lookups.figures

    def run(batches):
        for batch in batches:
            f, (before, word) = shared.value, _ends(batch)
            of = lambda name, mine, at: np.where(at < 0, np.stack([np.asarray(batch.column(f"{name}{c}")) for c in (0, 1)]), mine[:, np.maximum(at, 0)])
            n, plain = np.stack([np.asarray(batch.column(c)) for c in ("n0", "n1")]), np.asarray(batch.column("plain"))
            ratio = _ratio(f.cut, of("mass", f.mass, before), of("gain", f.gain, before), of("low", f.low, word), n)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("at"), pa.array((ratio - plain).astype(np.float32)), pa.array((_peak(ratio) - _peak(plain)).astype(np.float32))], ["row", "at", "delta", "peak"])

    return asked.mapInArrow(run, "row long, at int, delta float, peak float")


def _column(t: pa.Table, name: str) -> np.ndarray:
    return np.asarray(t.column(name).combine_chunks()) if t.num_rows else np.zeros(0, np.int64)


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a text that is null, empty or without words scores as an empty one.

    Repeated rows get equal scores, one row each; other columns are not read.
    """

    return _scored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), model)


def _scored(texts: DataFrame, model: ToxicityModel) -> DataFrame:
    carry, reading = [c for c in texts.columns if c != "text"], model.reading

    def score(batches):
        for batch in batches:
            x = np.stack([np.asarray(batch.column(c)) for c in "abcde"], axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(reading.score(x))], [*carry, "score"])

    figures = _figures(texts, model.models, model.lookups)
    return figures.mapInArrow(score, "".join(f"{c} {kind}, " for c, kind in texts.dtypes if c != "text") + "score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs without those that score `least` or more; all columns stay.

    Nothing is shuffled where the tasks hold all of the models; else the texts
    that go are listed by two hashes, and docs joined with that list.
    A model that had no label to learn from (all weights are zero) rejects nothing.
    """
    if not np.any(model.reading.weights):
        return docs
    if model.lookups is not None:
        h, g = fresh(docs, "h", "g")
        hashes = lambda c: [F.xxhash64(F.coalesce(c, F.lit(""))), F.xxhash64(F.lit(1), F.coalesce(c, F.lit("")))]
        first, second = hashes(F.col(text))
        bad = _scored(docs.select(first.alias(h), second.alias(g), F.col(text).alias("text")), model).where(F.col("score") >= least)
        bad = _settle(bad.select(h, g).distinct(), "toxic-texts")
        return docs.join(bad, (first == bad[h]) & (second == bad[g]), "left_anti")

    models, reading = model.models, model.reading

    def keep(batches):
        for batch in batches:
            data, offsets, _ = K.column_bytes(batch.column(text))
            scores = [reading.score(models.value.features(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a])) for a, b in K.pieces(offsets)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *scores]) < least))

    return docs.mapInArrow(keep, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's scores; a row with a null id belongs to no held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
