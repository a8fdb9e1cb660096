import random

import pytest
import test_decontaminate
import test_jaccard

import corpus_pipeline as C
import __spark_entry__ as E


def corpus():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    bad = ["nastyword", "vileword", "scornword"]
    docs, labels = [], []
    for i in range(400):
        words = text(rng.randint(30, 120)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(8):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words), "en", f"src{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    passage, bench = text(60), text(30)
    docs += [(1000, docs[1][1], "en", "s", 0), (1001, docs[2][1] + " tail", "en", "s", 0)]  # copies of clean documents
    docs += [(1002, text(40) + " " + passage + " " + text(40), "en", "s", 0), (1003, text(50) + " " + passage + " " + text(50), "en", "s", 0)]
    docs += [(1004, text(20) + " " + bench + " " + text(20), "en", "s", 0), (1005, None, None, None, None), (None, text(30), "en", "s", 0)]
    return docs, labels, bench, passage


def test_stages_and_run(spark, tmp_path):
    docs, labels, bench, passage = corpus()
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    at = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, at, d)
        out.write.parquet(f"{d}/{k}")
        at = spark.read.parquet(f"{d}/{k}")
        if k < 4:
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept[name] = {r.doc_id: r.text for r in at.collect()}
    toxic = {i for i, _, y in labels if y}
    assert len(toxic & set(kept["toxicity"])) <= 3 and len(set(range(400)) - toxic - set(kept["toxicity"])) <= 6
    gone = set(kept["toxicity"]) - set(kept["near_duplicates"])
    assert gone == {x for x, y in ((1000, 1), (1001, 2)) if y in kept["toxicity"] and x in kept["toxicity"]}
    holders = [i for i in (1002, 1003) if i in kept["near_duplicates"]]
    assert [i for i in holders if passage in kept["repeats"][i]] == holders[:1]
    assert set(kept["repeats"]) - set(kept["decontamination"]) == ({1004} & set(kept["repeats"]))
    pieces = at.collect()
    assert {r.doc_id for r in pieces} == set(kept["decontamination"]) and all(r.round_trip for r in pieces)
    again = E.queries()["pipeline"](spark, d).collect()
    assert sorted(map(str, again)) == sorted(map(str, pieces))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sample int, key string, score double"


def write(spark, d, docs, labels, items):
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def stages(spark, d):
    """Rows (id, text) that each stage is given, and those of the last stage."""
    at, given = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (_, stage) in enumerate(C.STAGES):
        given.append([(r.doc_id, r.text) for r in at.collect()])
        stage(spark, at, d).write.parquet(f"{d}/{k}")
        at = spark.read.parquet(f"{d}/{k}")
    return given, at


def test_stages_match_brute_force_on_odd_rows(spark, tmp_path):
    docs, labels, bench, passage = corpus()
    rows = [(i, t, lang, source, n, 5, "key", 0.5) for i, t, lang, source, n in docs]
    long = "word " * 3000 + passage + "x" * 30_000
    odd = [(1010, ""), (1011, "... --"), (1012, "one"), (1013, "one"), (1014, long), (1014, long), (1015, "é" * 120 + " tail"), (1016, "ü " + "é" * 120), (1017, docs[5][1]), (1018, docs[5][1]), (None, None)]
    rows += [(i, t, None, None, None, None, None, None) for i, t in odd]
    write(spark, str(tmp_path), rows, labels + [(5, 1, None), (None, 1, 1), (5, None, 0)], [(1, bench), (2, None), (3, "")])
    given, at = stages(spark, str(tmp_path))
    assert {"doc_id", "text", "ids"} <= set(at.columns)

    comp = {d: c for d, (_, c) in test_jaccard.brute(given[1]).items()}
    assert sorted(map(str, given[2])) == sorted(map(str, {(d, t) for d, t in given[1] if d is not None and comp[d] == d} | {x for x in given[1] if x[0] is None}))

    kept, first = {}, {}
    for d, t in sorted((d, (t or "").encode()) for d, t in given[2] if d is not None):
        keep = [True] * len(t)
        for p in range(len(t) - 99):
            if t[p : p + 100] in first:
                keep[p : p + 100] = [False] * 100
            else:
                first[t[p : p + 100]] = d
        kept[d] = bytes(c for c, k in zip(t, keep) if k)
    want = {d: t for d, t in given[2] if d is not None and (kept[d] or not t)}
    got = {d: t for d, t in given[3] if d is not None}
    assert set(got) == set(want)
    # only whole characters go
    assert all((got[d] or "").encode() == kept[d] for d in got if (got[d] or "").isascii() and (want[d] or "").isascii())
    assert all(0 <= len((got[d] or "").encode()) - len(kept[d]) <= 6 for d in got)

    def clean(text):
        n, hit, _ = test_decontaminate.brute(text, [(1, bench)])
        return not (hit and 20 * hit >= n)

    assert sorted(map(str, given[4])) == sorted(str(x) for x in given[3] if clean(x[1]))
    last = at.collect()
    assert {(r.doc_id, r.text) for r in last} == set(given[4]) and all(r.round_trip for r in last)


@pytest.mark.parametrize("labelled", [False, True])
def test_empty_tables(spark, tmp_path, labelled):
    write(spark, str(tmp_path), [], [(1, 1, 1), (2, 1, 0)] if labelled else [], [])
    assert C.run(spark, str(tmp_path)).count() == 0


def test_nothing_learned_keeps_all(spark, tmp_path):
    rows = [(i, f"text number {i} of nine words that stand alone", None, None, None, None, None, None) for i in range(3)]
    write(spark, str(tmp_path), [*rows, (7, None, *[None] * 6)], [], [])
    assert {r.doc_id for r in C.run(spark, str(tmp_path)).collect()} == {0, 1, 2, 7}
