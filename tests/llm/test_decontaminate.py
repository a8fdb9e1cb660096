import hashlib
import pickle
import random
import re

import pytest

from strataline.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text, items, size=13):
    ws, hit, found = words(text), set(), set()
    for item, content in items:
        own = words(content)
        n = min(size, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        for i in range(len(ws) - n + 1) if windows else ():
            if tuple(ws[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(ws), len(hit), sorted(map(str, found))


LONG = " ".join(f"w{i}é" for i in range(40))
ITEMS = [(1, LONG), (2, "Short One"), (3, None), (4, ""), (5, "short one"), (10, " ".join(f"q{i}" for i in range(13)))]
DOCS = [
    (0, None, "x"), (1, "", "x"), (2, "nothing here", "x"), (3, LONG.upper().replace("É", "é"), "x"), (4, "a short, ONE b" * 3, "x"),
    (5, "z " * 300 + " ".join(LONG.split()[5:18]) + " z" * 300, "x"), (6, " ".join(LONG.split()[5:17]), "x"), (7, " ".join(f"q{i}" for i in range(13)), "x"),
    (7, " ".join(f"q{i}" for i in range(13)), "x"), (None, LONG, None), (8, "Ж" * 5000 + " " + LONG + " " + LONG, "x"), (9, "word " * 200_000 + LONG, "x"),
]


def test_set_is_a_small_multiple_of_the_benchmark():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(200)) for _ in range(500)]
    windows = D.BenchmarkWindows(list(range(500)), texts)
    arrays = [windows.buffer, windows.word_at, windows.item] + [x for t, cuts, places in windows.by_size.values() for x in (t.keys, t.rows, cuts, places)]
    size = sum(map(len, texts))
    assert sum(x.nbytes for x in arrays) < 8 * size and len(pickle.dumps(windows)) < 3 * size


@pytest.mark.parametrize("most_bytes", [1 << 20, 40])
def test_matches_brute_force(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(D.benchmark_blocks, "__defaults__", (most_bytes,))
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {}
    rows = D.contamination(docs, bench).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r["items"], r.contaminated))
    for doc, text, _ in DOCS:
        if len(text or "") < 100_000:
            n, hit, found = brute(text, ITEMS)
        else:
            n, hit, found = 200_040, 40, ["1"]
        assert (n, hit, found, hit > 0 and 20 * hit >= n) in got[doc]


def test_empty_tables_and_spans(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "keep short one this", 5), (2, None, 5)], "doc_id long, text string, n_words int")
    assert [r.contaminated for r in D.contamination(docs, none).collect()] == [False, False]
    bench = spark.createDataFrame([(1, "short one")], "item_id long, text string")
    assert sorted(D.remove_spans(docs, bench).collect(), key=lambda r: r.doc_id)[0].text == "keep  this"
    assert [r.doc_id for r in D.drop_contaminated(docs, bench).collect()] == [2]
    assert D.contamination(docs.limit(0), bench).count() == 0


def test_query_digest(spark, tmp_path):
    spark.createDataFrame(DOCS[:8], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for r in D.op1_decontaminate(spark, str(tmp_path)).collect():
        text = next(t for d, t, _ in DOCS if d == r.doc_id)
        _, _, found = brute(text, ITEMS)
        assert r.n_items == len(found) and r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_hits_spread_over_blocks(spark, monkeypatch, tmp_path):
    import corpus_pipeline as C

    names = ["alpha", "beta", "gamma", "delta"]
    items = [(k, " ".join(f"{x}{i}" for i in range(13))) for k, x in enumerate(names)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    spread = "v " * 500 + " ".join(t for _, t in items[:2]) + " u" * 300 + f" {items[2][1]} " + "u " * 100  # 4 % of words in all
    seam = items[0][1] + " " + " ".join(items[1][1].split()[:6]) + f" {items[2][1]} " + " ".join(items[1][1].split()[6:])
    docs = spark.createDataFrame([(1, spread, 7), (2, "u " * 100 + spread[1000:], 7), (3, seam, 7), (4, None, None), (None, "clean words", 7)], "doc_id long, text string, n_words int").repartition(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    cut = lambda: {r.doc_id: (r.text, r.n_words) for r in D.remove_spans(docs, bench).collect()}
    kept = lambda: {r.doc_id for r in C.decontamination_stage(spark, docs, str(tmp_path)).collect()}
    one, whole = cut(), kept()
    assert whole == {1, 4, None}
    assert D.benchmark_blocks(bench, "item_id", "text", 40)[0] > 3
    monkeypatch.setattr(D.benchmark_blocks, "__defaults__", (40,))
    assert cut() == one and kept() == whole
    assert whole == {r.doc_id for r in D.contamination(docs, bench).where("not contaminated").collect()}
