import random
import zlib

import numpy as np

from strataline.llm import quality as Q


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def rows(n=400):
    rng = random.Random(3)
    out = []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 120))]
        out.append((i, " ".join(w if good else w + "%%%" for w in words), "fr" if good else "de", int(good)))
    return out


def test_statistics_match_plain_counts():
    texts = ["a bb a\na bb a\n\nX9|", "", "é é é", "one"]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])[:-1]
    got = dict(zip(Q.STATISTICS, Q.statistics(np.frombuffer(b"".join(raw), np.uint8), bounds).T))
    assert np.allclose(got["log_words"], np.log1p([7, 0, 3, 1]))
    assert np.allclose(got["distinct_words"], [3 / 7, 0, 1 / 3, 1])
    assert np.allclose(got["top_word"], [4 / 7, 0, 1, 1])
    assert np.allclose(got["repeat_next"], [1 / 7, 0, 2 / 3, 0])
    assert np.allclose(got["distinct_lines"], [2 / 3, 0, 1, 1])
    assert np.allclose(got["mark_124"], [1 / 7, 0, 0, 0])


def test_flattened_trees_match_walking_each_row():
    rng = np.random.RandomState(0)
    x = rng.rand(500, 6).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.2)).astype(float)
    model = Q.grow(x, y, trees=20)
    p = model.score(x)
    for k in range(0, 500, 37):
        total = model.bias
        for root in model.roots:
            at = root
            while model.left[at] != at:
                at = model.left[at] if x[k, model.feature[at]] <= model.cut[at] else model.right[at]
            total += model.value[at]
        assert abs(p[k] - 1 / (1 + np.exp(-total))) < 1e-9
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.95


def test_held_out_accuracy_and_edges(spark, tmp_path):
    data = rows()
    odd = [(1000, None, None), (1001, "", "x"), (None, "text", "x"), (1002, "word " * 300_000, "x")]
    spark.createDataFrame([d[:3] for d in data] + odd, "doc_id long, text string, label string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], d[3]) for d in data] + [(1, None), (None, 1), (2, data[2][3])], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Q.op3_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(data) + len(odd) and all(0 <= r.score <= 1 for r in got)
    truth = {d[0]: d[3] for d in data}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(held_out(r.doc_id) for r in held) and len(held) > 40
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.score_quality(docs, Q.fit_quality(docs, none)).first().score == 0.5
    assert Q.score_quality(docs.limit(0), Q.fit_quality(docs.limit(0), none)).count() == 0
