import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strataline.llm import langid as L

STEMS = {"xx": ["kalo", "miru", "taso", "éno"], "yy": ["schtr", "bruck", "glomp", "würt"], "zz": ["ооп", "жук", "мир", "лес"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_counts_match_plain_counts():
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "b"], "text": ["Ab ab, É2ab", "ab"]})
    got = Counter()
    for part in L._counts([batch]):
        for lang, order, n in zip(*(part.column(c).to_pylist() for c in ("lang", "ord", "n"))):
            got[lang, order] += n
    # framed words: "_ab_" three times and "_é_" for a; "_ab_" for b
    assert got == {("a", 0): 4, ("a", 1): 7, ("a", 2): 11, ("a", 3): 7, ("a", 4): 3, ("b", 0): 1, ("b", 1): 2, ("b", 2): 3, ("b", 3): 2, ("b", 4): 1}


def test_held_out_accuracy(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, text(rng, lang := rng.choice(list(STEMS)), rng.randint(2, 60)), lang) for i in range(300)]
    odd = [(900, None, "xx"), (901, "", "yy"), (902, "12 %% 34", "xx"), (903, "kalomiru", None), (None, "kalo", "xx"), (904, "Ж" * 400_000, "zz")]
    spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id long, text string, lang string, score int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in L.op5_language(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + len(odd)
    assert [got[k].lang_pred for k in (900, 901, 902, 903, 904)] == ["und", "und", "und", "xx", "zz"]
    held = [(got[i], lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 40 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r, _ in held)
    assert np.mean([r.lang_pred == lang for r, lang in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_unseen_words_use_shorter_ngrams(spark):
    docs = spark.createDataFrame([("kalokalo", "xx"), ("bruckglomp", "yy")], "text string, lang string")
    model = L.fit_languages(docs)
    ask = spark.createDataFrame([(1, "kalomiru okal"), (2, "glo")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in L.identify(ask, model).collect()} == {1: "xx", 2: "yy"}


def test_nothing_learned(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    ask = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert L.identify(ask, L.fit_languages(none)).first().lang_pred == "und"
    assert L.identify(ask.limit(0), L.fit_languages(none)).count() == 0


def plain_scores(learn, ask):
    """Share of each language by a plain reading of words first, then of the longest known n-gram at each letter."""
    def words(text):
        runs, run = [], ""
        for c in (text or "") + " ":
            if c.isalpha() or unicodedata.category(c)[0] == "M":
                run += c.lower() if len(c.lower()) == 1 else c
            else:
                runs, run = runs + [run] * any(x.isalpha() for x in run), ""
        return runs

    counts = {o: {} for o in (0, 4, 3, 2, 1)}
    for text, lang in learn:
        if text is None or lang is None:
            continue
        for w in words(text):
            f = f" {w} "
            for o, part in [(0, [w]), *((o, [f[i : i + o] for i in range(len(f) - o + 1) if f[i : i + o] != " "]) for o in (1, 2, 3, 4))]:
                for x in part:
                    counts[o].setdefault(x, Counter())[lang] += 1
    langs = sorted({x for c in counts[0].values() for x in c})
    total = {o: {x: sum(c[x] for c in counts[o].values()) for x in langs} for o in counts}

    def gains(o, x):
        return np.array([np.log(max(counts[o][x][k] / total[o][k], 0.5 / max(total[o].values()))) if total[o][k] else np.log(0.5 / max(total[o].values())) for k in langs]) / max(o, 1)

    out = []
    for text in ask:
        s, found = np.zeros(len(langs)), words(text)
        for w in found:
            if w in counts[0]:
                s += gains(0, w)
                continue
            f = f" {w} "
            for end in range(1, len(f) + 1):
                for o in (4, 3, 2, 1):
                    if end >= o and f[end - o : end] in counts[o]:
                        s += gains(o, f[end - o : end])
                        break
        p = np.exp(s - s.max())
        out.append((langs[int(s.argmax())], (p / p.sum()).max()) if found else ("und", 0.0))
    return out


@pytest.mark.parametrize("most,share", [(1 << 20, 0.0), (40, 0.0), (0, 0.0), (1 << 20, 0.02)])
def test_equals_plain_backoff_whatever_is_frequent(spark, most, share):
    rng = random.Random(8)
    learn = [(text(rng, lang := rng.choice(list(STEMS)), rng.randint(1, 12)), lang) for _ in range(40)]
    learn += learn[:3] + [(None, "xx"), ("loner", None), ("", "yy"), ("नमस्ते दुनिया", "hi"), ("Straße İx", "yy")]
    ask = [text(rng, rng.choice(list(STEMS)), rng.randint(1, 4)) + rng.choice(["", " kaloq", " qbru brqq", " мирtaso", " ्"]) for _ in range(60)]
    ask += [None, "", " ् 12", "qqqq", "नमस्", "STRASSE straße", ask[0], ask[1], "kalo " * 50 + "q" * 300]
    model = L.fit_languages(spark.createDataFrame(learn, "text string, lang string").repartition(3), most=most, share=share)
    rows = spark.createDataFrame([(i // 2 if i % 7 else None, x, i) for i, x in enumerate(ask)], "doc_id long, text string, score int").repartition(3)
    got = sorted((r.doc_id or -1, r.lang_pred, round(r.score, 6)) for r in L.identify(rows, model).collect())
    want = plain_scores(learn, ask)
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in sorted((i // 2 if i % 7 and i // 2 else -1, w, round(float(s), 6)) for i, (w, s) in enumerate(want))]
    assert Counter(x for _, x, _ in got) == Counter(w for w, _ in want)


def test_ties_go_to_the_first_language(spark):
    learn = spark.createDataFrame([("abc", "yy"), ("abc", "xx")], "text string, lang string")
    ask = spark.createDataFrame([(1, "abc"), (1, "abc"), (2, "ÿ")], "doc_id long, text string")
    got = L.identify(ask, L.fit_languages(learn)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("xx", 0.5)] * 3
