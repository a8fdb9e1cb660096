import hashlib
import random

import numpy as np
import pytest

from strataline.llm import repeats as R


def brute(docs, least):
    """docs: (id, bytes); windows judged one by one."""
    first, out = {}, {}
    for d, raw in sorted(docs):
        keep = np.ones(len(raw), bool)
        for p in range(len(raw) - least + 1):
            w = raw[p : p + least]
            if w in first:
                keep[p : p + least] = False
            else:
                first[w] = (d, p)
        kept = np.frombuffer(raw, np.uint8)[keep].tobytes()
        spans = int(np.sum(np.diff(np.r_[1, keep.astype(int)]) == -1))
        out[d] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    passage = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage)
            a = rng.randint(0, 30)
            parts += [p[a : len(p) - rng.randint(0, 30)], " ".join(word() for _ in range(rng.randint(0, 12)))]
        texts.append("".join(parts))
    texts += [texts[3], texts[3], "ab" * 400, "x" * 99, "x" * 100, "x" * 500, None, "", texts[5][:50] + "Z" + texts[5][50:]]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,block", [(1, 60_000), (2, 37), (3, 5), (4, 2)])
def test_matches_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(R, "SCAN_ROWS", block)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows] + [(None, "y" * 300, 1, 2)], "doc_id long, text string, seed int, start int").repartition(3)
    expect = brute([(i, (t or "").encode()) for i, t in rows], 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.removal_digest(docs).collect()}
    assert got.pop(None)[1] == 0
    assert got == expect


def test_long_text_and_repeated_rows(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000)) + base + "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    docs = spark.createDataFrame([(1, base), (2, long), (1, base)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.n_spans) for r in R.removal_digest(docs).collect())
    assert got == [(1, 0, 0), (1, 0, 0), (2, 3000, 1)]


@pytest.mark.parametrize("most", [100_000, 0])
def test_ids_with_several_texts(spark, monkeypatch, most):
    monkeypatch.setattr(R, "SMALL_ROWS", most)
    rng = random.Random(6)
    fresh = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core, other = fresh(150), fresh(120)
    rows = [(1, core + fresh(40)), (1, fresh(30) + core), (1, fresh(300)), (2, fresh(10) + core), (2, other), (2, "short"), (2, None), (3, other + "!"), (3, fresh(200)), (None, core)]
    rows += rows[:2]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, _n int").repartition(2)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in R.removal_digest(docs).collect())
    # one of the two texts of id 1 that hold the core comes first, the other one loses it
    lost = [x for x in got if x[0] == 1 and x[2]]
    assert len(lost) == 2 and len(set(lost)) == 1 and lost[0][2:] == (150, 1)
    assert [x for x in got if x[0] != 1] == sorted([(0, 150, 0, 0), (2, 160, 150, 1), (2, 120, 0, 0), (2, 5, 0, 0), (2, 0, 0, 0), (3, 121, 120, 1), (3, 200, 0, 0)])
    cut = [(r.doc_id, r.text) for r in R.cut_repeats(docs).collect()]
    assert sum(core in (t or "") for i, t in cut if i == 1) == 2 and len(cut) == len(rows)
    assert {(i, t) for i, t in cut if i == 2} == {(2, rows[3][1][:10]), (2, other), (2, "short"), (2, None)}
    assert {(i, t) for i, t in cut if i == 3} == {(3, "!"), (3, rows[8][1])}


def test_cut_keeps_whole_characters(spark):
    rng = random.Random(4)
    core = "".join(rng.choice("éüäö") for _ in range(80))
    a, b = core + "tail", "ë" + core + "tail!"
    docs = spark.createDataFrame([(1, a, "x"), (2, b, "y"), (3, a, "z"), (4, None, None)], "doc_id long, text string, starts string")
    got = {r.doc_id: r.text for r in R.cut_repeats(docs).collect()}
    assert got == {1: a, 2: "ë!", 4: None}
    assert R.cut_repeats(docs.limit(0)).count() == 0


def test_intervals():
    assert sorted(R.intervals(np.array([3, 5, 5, 2, 0, 4]), 1)) == [(0, 3, 3), (0, 4, 2), (1, 3, 5), (5, 6, 4)]
