import random
import re

import pytest

from strataline.llm import jaccard as J

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {d: grams(t) for d, t in rows if d is not None}
    links = {d: [e for e in sets if e != d and sets[d] and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e])] for d in sets}
    comp = {d: d for d in sets}
    change = True
    while change:
        change = False
        for d in sets:
            low = min([comp[d], *(comp[e] for e in links[d])])
            if low < comp[d]:
                comp[d], change = low, True
    return {d: (len(links[d]), comp[d]) for d in sets}


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(3, 150))]
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += [rows[0], rows[0].upper(), rows[5] + "!", "", None, "--", "one", "one", "é è", "É è"]
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [512, 7])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows] + [(None, rows[0][1], "x", 0)], "doc_id long, text string, band string, i int").repartition(3)
    got = J.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: (r.n_links, r.component_id) for r in got if r.doc_id is not None} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_ids_with_several_texts(spark):
    """Every row is a document of its own; n_links and groups follow the rows, not the ids."""
    words = [t for _, t in corpus()]
    docs = [(i // 2, t) for i, t in enumerate(words)] + [(0, words[0]), (0, words[1])]
    by_row = brute(list(enumerate(t for _, t in docs)))
    want = sorted((i, by_row[r][0], min(docs[k][0] for k in by_row if by_row[k][1] == by_row[r][1])) for r, (i, _) in enumerate(docs))
    got = J.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in got.collect()) == want


def test_representatives_of_ids_with_several_texts(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a, "z", {"k": 1}), (1, a, "y", {"k": 1}), (1, b, "x", None), (2, a + " w60", "x", None), (3, b + " v60", "x", None), (4, "", "x", None), (None, a, "x", None), (None, a, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, m map<string,int>").repartition(4)
    kept = J.keep_representatives(docs).collect()
    assert sorted((str(r.doc_id), r.text, r.h) for r in kept) == sorted([("1", a, "y"), ("1", b, "x"), ("4", "", "x"), ("None", a, "x"), ("None", a, "x")])


def test_long_texts(spark):
    base = [f"w{i % 40_000}x{i}" for i in range(150_000)]
    docs = spark.createDataFrame([(i, " ".join(base[: 150_000 - 10 * i])) for i in range(6)], "doc_id long, text string")
    assert {(r.n_links, r.component_id) for r in J.near_duplicates(docs).collect()} == {(5, 0)}


def test_edges(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", 1), (1, "a b c d e f", 1), (1, "a b c d e f", 1), (None, "a b c d e f", 1), (4, "", 1)], "doc_id long, text string, s1 int")
    assert sorted(r.doc_id or 0 for r in J.keep_representatives(docs).collect()) == [0, 1, 4]
    assert J.near_duplicates(docs.limit(0)).count() == 0


def test_pruning_bound():
    need = J.least_matches(0.8, 1e-6)
    assert need[16] < 12 and 75 < need[128] < 90
