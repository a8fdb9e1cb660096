import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from strataline.llm import textkit as K
from strataline.llm import toxicity as T


def fold(doc):
    return zlib.crc32(str(doc).encode()) % 5


def rows(n=700):
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    bad = ["nastyword", "vileword", "scornword"]
    out = []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = [rng.choice(plain) for _ in range(rng.randint(20, 150))]
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((i, " ".join(words), int(toxic)))
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


class Plain:
    """Interpolated Kneser-Ney from its definition, one word at a time, over dicts."""

    def __init__(self, texts, corpus, known):
        self.known, self.pairs = known, Counter()
        for text in texts:
            before = "<s>"
            for w in words_of(text):
                w = w if w in known else "<unk>"
                self.pairs[before, w] += 1
                before = w
        self.cut = self.discount(list(self.pairs.values()))
        self.low_cut = self.discount([sum(b == w for _, b in self.pairs) for w in {b for _, b in self.pairs}])
        seen = Counter(w if w in known else "<unk>" for text in corpus for w in words_of(text))
        size = len(known) + 2
        self.base = {w: (seen[w] + 0.5) / (sum(seen.values()) + 0.5 * size) for w in [*known, "<unk>", "<s>"]}

    def discount(self, counts):
        once, twice = counts.count(1), counts.count(2)
        return once / (once + 2 * twice) if once else 0.5

    def p(self, v, w):
        left = {a for a, b in self.pairs if b == w}
        kinds = {b for _, b in self.pairs}
        low = max(len(left) - self.low_cut, 0) / len(self.pairs) + self.low_cut * len(kinds) / len(self.pairs) * self.base[w] if self.pairs else self.base[w]
        after = {b: n for (a, b), n in self.pairs.items() if a == v}
        mass = sum(after.values())
        return max(after.get(w, 0) - self.cut, 0) / mass + self.cut * len(after) / mass * low if mass else low


def test_models_equal_plain_kneser_ney(spark):
    rng = random.Random(3)
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    texts = [(i, text(["a", "b", "c", "dd", "É", f"x{i}"], 9), int(i % 3 == 0)) for i in range(60)] + [(100, "A a  b!a", 1), (101, "", 0), (102, None, 1), (103, "...", 0)] + [(104, "a " * 400, 0)]
    other = [(i, text(["a", "b", "zz", "q"], 5)) for i in range(200, 230)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts] + other, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    models = T.fit_toxicity(docs, labels, count_folds=(0, 1, 2, 3, 4)).models.value
    seen = Counter(w for _, t, _ in texts for w in words_of(t))
    known = {w for w in seen if seen[w] >= 2}
    assert 0 < len(known) < len(seen)
    all_ = [t for _, t, _ in texts] + [t for _, t in other]
    plain = [Plain([t for _, t, y in texts if y == c], all_, known) for c in (0, 1)]
    assert max(max(p.pairs.values()) for p in plain) > 255 and any(n == 1 for p in plain for n in p.pairs.values())
    for probe in ["a b c dd x3 x4 zz nowhere a É a", "x5", "zz zz q a a a"]:
        data, offsets, _ = K.column_bytes(pa.array([probe]))
        word, before, _ = models.vocabulary.numbers(data, offsets[:-1])
        got = models.likelihoods(before, word)
        seq = ["<s>", *(w if w in known else "<unk>" for w in words_of(probe))]
        want = np.array([[p.p(v, w) for v, w in zip(seq, seq[1:])] for p in plain])
        assert np.allclose(got, want, rtol=1e-4)
        diff = np.log(want[1]) - np.log(want[0])
        assert np.isclose(models.features(data, offsets[:-1])[0, 0], diff.mean(), rtol=1e-3, atol=1e-5)
    for c in (0, 1):
        for v in (0, 1, 2, 5):
            size = models.vocabulary.size
            assert abs(models.likelihoods(np.full(size, v), np.arange(size))[c].sum() - 1) < 1e-4


def test_counts_survive_the_broadcast():
    rng = np.random.RandomState(2)
    keys = np.unique(rng.randint(0, 1 << 60, 5000))
    n = rng.randint(1, 600, len(keys))
    back = pickle.loads(pickle.dumps(T.PairCounts(keys, n)))
    probes = np.sort(np.r_[keys[::3], keys[::5] + 1])
    known = dict(zip(keys.tolist(), n.tolist()))
    assert back.find(probes).tolist() == [known.get(k, 0) for k in probes.tolist()]
    assert T.PairCounts(keys[:0], n[:0]).find(probes).sum() == 0


def test_blank_and_wordless_partitions(spark):
    data = rows(200)
    docs = spark.createDataFrame([(d, t) for d, t, _ in data], "doc_id long, text string")
    model = T.fit_toxicity(docs, spark.createDataFrame([(d, y) for d, _, y in data], "doc_id long, toxic int"))
    blank = spark.createDataFrame([(i, "...") for i in range(4)] + [(5, ""), (6, None), (7, " ")], "doc_id long, text string")
    for parts in (1, 7):
        scores = {r.score for r in T.score_toxicity(blank.repartition(parts), model).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() <= 1
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    assert T.score_toxicity(blank, T.fit_toxicity(blank, labels)).count() == 7


def test_held_out_accuracy_and_edges(spark, tmp_path):
    data = rows()
    odd = [(5000, None), (5001, ""), (None, "nastyword"), (5002, "abc " * 300_000), (5003, "...")]
    spark.createDataFrame([(d[0], d[1], "x") for d in data] + [(*o, "y") for o in odd], "doc_id long, text string, label string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], d[2]) for d in data] + [(1, None), (None, 1), (2, data[2][2])], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in T.op6_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(data) + len(odd) and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[d], y) for d, _, y in data if fold(d) == 0]
    assert len(held) > 100 and all(r.held_out for r, _ in held)
    assert np.mean([r.predicted == y for r, y in held]) > 0.95
    model = T.fit_toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    docs = spark.createDataFrame([(1, data[0][1], 2), (2, data[0][1] + " nastyword vileword scornword nastyword", 2)], "doc_id long, text string, key int")
    assert 2 not in [r.doc_id for r in T.drop_toxic(docs, model).collect()]


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.score_toxicity(docs, T.fit_toxicity(docs, none)).collect()] == [0.5, 0.5]
    assert T.score_toxicity(docs.limit(0), T.fit_toxicity(docs.limit(0), none)).count() == 0


def test_all_labelled_documents_count(spark, monkeypatch):
    """More labelled documents than the 30,000 and 8,000 that were once drawn: each word of each adds up."""
    n = 56_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('every w', id % 50, ' w', id % 7) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as toxic")
    seen, reading = [], T._reading
    monkeypatch.setattr(T, "_reading", lambda figures: seen.append(figures.count()) or reading(figures))
    monkeypatch.setattr(T, "LABEL_BLOCK", 20_000)
    models = T.fit_toxicity(docs, labels).models.value
    begin = sum(float(models.mass[c][1]) for c in (0, 1))  # one word of each text stands at its start
    folds = Counter(map(fold, range(n)))
    assert begin == folds[2] + folds[3] + folds[4] > 30_000
    assert seen == [folds[1]] and folds[1] > 8_000


def test_bounded_models_keep_every_count(spark, monkeypatch):
    data = rows(200)
    docs = spark.createDataFrame([(d, t) for d, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in data], "doc_id long, toxic int")
    fit = lambda: T.fit_toxicity(docs, labels, count_folds=(0, 1, 2, 3, 4)).models.value
    whole = fit()
    size = sum(len(p.keys) for p in whole.pairs)
    monkeypatch.setattr(T, "MOST_PAIRS", size // 2)
    small = fit()
    seen = Counter(w for _, t, _ in data for w in words_of(t))
    least = min(k for k in seen.values() if sum(c >= k for c in seen.values()) == small.vocabulary.size - 2)
    plain = [Plain([t for _, t, y in data if y == c], [t for _, t, _ in data], {w for w in seen if seen[w] >= least}) for c in (0, 1)]
    assert 2 < small.vocabulary.size < whole.vocabulary.size and sum(len(p.keys) for p in small.pairs) <= size // 2
    for c in (0, 1):
        assert sorted(small.pairs[c].find(small.pairs[c].keys).tolist()) == sorted(plain[c].pairs.values())
    monkeypatch.setattr(T, "MOST_WORDS", 20)
    assert fit().vocabulary.size <= 22


def test_bounds_change_no_score(spark, monkeypatch):
    """What the tasks are not told of words and pairs is looked up: scores and the documents kept are those of the whole models."""
    rng = random.Random(4)
    data = rows(400)
    rare = [(d, t + "".join(f" seldom{rng.randrange(120)} {rng.choice('abc')}" for _ in range(8)) + (" vile" + rng.choice("xyz") if y else ""), y) for d, t, y in data]
    odd = [(None, "a vilex seldom3 b"), (9000, ""), (9001, None), (9002, "never seen at all"), (9003, rare[5][1]), (9004, " ".join(t for _, t, _ in rare[:40]))]
    docs = spark.createDataFrame([(d, t, 1) for d, t, _ in rare] + [(*o, 2) for o in odd], "doc_id long, text string, h int").repartition(3)
    labels = spark.createDataFrame([(d, y) for d, _, y in rare], "doc_id long, toxic int")

    def scores():
        model = T.fit_toxicity(docs, labels)
        kept = sorted(map(str, T.drop_toxic(docs, model).collect()))
        return model, sorted((r.doc_id or -1, r.score) for r in T.score_toxicity(docs, model).collect()), kept

    whole, want, kept = scores()
    assert whole.models.value.vocabulary.size > 300 and 0 < len(kept) < len(rare)
    for bounds in ({"MOST_PAIRS": 3000}, {"SHARE": 0.01}, {"MOST_WORDS": 150}, {"MOST_PAIRS": 1000, "MOST_WORDS": 60, "SLOTS": 4, "TURNS": 2}):
        with monkeypatch.context() as m:
            for name, value in bounds.items():
                m.setattr(T, name, value)
            model, got, left = scores()
        assert model.models.value.vocabulary.size < whole.models.value.vocabulary.size
        assert [d for d, _ in got] == [d for d, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-4, atol=1e-6), bounds
        assert left == kept
