import numpy as np
import pytest

from strataline.llm import embeddings as E


def brute(rows, cosine=0.93):
    ok = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            w = np.array(v, np.float64)
            ok[i] = (label, w / np.linalg.norm(w))
    links = {i: [j for j in ok if j != i and ok[j][0] == ok[i][0] and len(ok[j][1]) == len(ok[i][1]) and ok[i][1] @ ok[j][1] >= cosine] for i in ok}
    comp = {i: i for i in ok}
    change = True
    while change:
        change = False
        for i in ok:
            low = min([comp[i], *(comp[j] for j in links[i])])
            if low < comp[i]:
                comp[i], change = low, True
    return {i: (len(links.get(i, [])), comp.get(i, i)) for i, _, _ in rows if i is not None}


def corpus():
    rng = np.random.RandomState(2)
    rows = []
    for k in range(40):
        centre = rng.randn(16)
        for _ in range(rng.randint(1, 14)):
            rows.append((centre + rng.randn(16) * rng.choice([0.02, 0.2, 0.35])).tolist())
    rows += [rows[0], rows[0], [2 * x for x in rows[0]], rows[7]]
    out = [(i, v, int(rng.randint(0, 3))) for i, v in enumerate(rows)]
    n = len(out)
    return out + [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [1.0, None], 1), (n + 5, rows[0], None), (n + 6, [1.0, 0.0], 0), (n + 7, [1.0, 0.1], 0), (n + 8, [float("inf")] * 16, 1)]


@pytest.mark.parametrize("block,leaf,fan", [(512, 64, 16), (9, 3, 2)])
def test_matches_brute_force(spark, monkeypatch, block, leaf, fan):
    monkeypatch.setattr(E, "BLOCK_ROWS", block)
    monkeypatch.setattr(E, "LEAF_ROWS", leaf)
    monkeypatch.setattr(E, "FAN_OUT", fan)
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(None, rows[0][1], 1, "x", 1)], "vec_id long, embedding array<float>, label int, size string, box int").repartition(3)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(df).collect()}
    assert got.pop(None) == (0, None)
    assert got == brute(single)


def test_empty(spark):
    assert E.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_ids_with_several_vectors(spark):
    rows = [(i, v, y) for i, v, y in corpus() if v and None not in v]
    rows += [(len(rows) + 50, *rows[0][1:]), (len(rows) + 51, *rows[0][1:])]
    rows = [(k, [float(np.float32(x)) for x in v], y) for k, (_, v, y) in enumerate(rows)]
    plain, of = brute(rows), lambda k: k // 2
    want = sorted((of(k), plain[k][0], min(of(j) for j in plain if plain[j][1] == plain[k][1])) for k in plain)
    df = spark.createDataFrame([(of(k), v, y) for k, v, y in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_vectors(df).collect()) == want


def test_block_numbers_have_no_gaps(spark):
    blocks = spark.createDataFrame([((task << 32) + k, "x") for task in (0, 3, 4, 9) for k in range(1, task + 2)], "block long, label string")
    assert sorted(r.block for r in E._numbered(blocks).collect()) == list(range(1 + 4 + 5 + 10))


def test_sizes_and_labels_are_told_apart(spark):
    rows = [(1, 0, 8193), (2, 0, 8193), (3, 1, 1), (4, 1, 1), (5, 2, 1), (6, 2, 8193)]
    axes = spark.sparkContext.broadcast({8193: np.eye(8193, E.BOX_DIMS), 1: np.ones((1, 1))})
    vectors = spark.createDataFrame([(n, label, size, 1, bytearray(np.ones(size).tobytes())) for n, label, size in rows], "node long, label long, size int, copies long, vector binary").coalesce(1)
    blocks = vectors.mapInArrow(E._cut_blocks(axes), "block long, label long, size int, box array<float>, ids binary, copies binary, vectors binary").collect()
    assert [(r["label"], r["size"], np.frombuffer(r.ids, np.int64).tolist()) for r in blocks] == [(0, 8193, [1, 2]), (1, 1, [3, 4]), (2, 1, [5]), (2, 8193, [6])]


def test_axes_of_long_vectors(spark):
    rng = np.random.RandomState(4)
    rows = [(i, (rng.randn(1500) * (np.arange(1500) < 40) + (5 if i % 3 == 0 else 0.01)).tolist(), i % 2) for i in range(60)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == brute([(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows]) and any(n for n, _ in got.values())
