import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from strataline.llm import collocations as C

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER))]


def brute(rows, most, least, top, cover):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            for n in range(1, most + 1):
                f.update((lang, tuple(w[k : k + n])) for k in range(len(w) - n + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in candidates.items():
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:c]] + f[lang, w[c:]]), c, f[lang, w[:c]], f[lang, w[c:]]) for c in range(1, len(w)))
        inside = lambda x: any(x[k : k + len(w)] == w for k in range(len(x) - len(w) + 1))  # noqa: B023, E731
        if not any(g == lang and len(x) > len(w) and 100 * b >= cover * a and inside(x) for (g, x), b in candidates.items()):
            out.setdefault(lang, []).append((score, a, " ".join(w), left, right))
    return sorted((lang, rank, p, a, left, right, total[lang], score) for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found, key=lambda x: (-x[0], -x[1], x[2].encode()))[:top], 1))


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "C", "dé", "e f", "(g", "日本", "'s"]
    say = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(60)))
    return [(rng.choice(["x", "y", None, "und", ""]), rng.choice([say(), say(), say(), None, "", "a a a a a a a a"])) for _ in range(n)]


@pytest.mark.parametrize(("most", "least", "top", "size"), [(4, 3, 2_000, 1 << 21), (4, 5, 7, 50), (2, 2, 2_000, 500), (5, 4, 20, 1)])
def test_matches_brute_force(spark, most, least, top, size):
    rows = texts(most * 100 + least, 120)
    docs = spark.createDataFrame([(*r, 1, "z", "q") for r in rows], "lang string, text string, n int, phrase string, keys string").repartition(3)
    got = C.top_collocations(docs, most_words=most, least=least, top=top, segment_words=size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {k for c, k in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == brute(rows, most, least, top, 80)


def test_long_texts_are_cut_between_pieces(spark):
    rng = random.Random(3)
    long_ = " ".join(rng.choice("abcdefgh") + rng.choice(["", "", "", "."]) for _ in range(1_500_000))
    whole = "".join(rng.choice("pq") + " " for _ in range(1_200_000))  # nowhere to cut
    rows = [("x", "a b c"), ("x", long_), ("x", None), ("y", whole), ("x", "h g a")]
    got = C.top_collocations(spark.createDataFrame(rows, "lang string, text string").coalesce(1))
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 30, 2_000, 80)


def test_lists_and_empty_tables(spark):
    counts, positions = np.array([2, 1, 3]), np.array([5, 900_000, 0, 1, 2, 7])
    assert C._unpacked(C._packed(positions, counts), counts).tolist() == positions.tolist()
    docs = spark.createDataFrame(texts(1, 5), "lang string, text string")
    assert C.top_collocations(docs.limit(0)).count() == 0
    assert C.top_collocations(docs.selectExpr("lang", "CAST(NULL AS string) AS text")).count() == 0
    assert pa.decompress(C._packed(positions, counts), 24, "zstd", asbytes=True)


def test_scores_of_very_frequent_phrases_are_exact(spark):
    big = 9_000_000_000_000_000
    rows = [("x", "a", 1, big + 7), ("x", "b", 1, big), ("x", "a b", 2, big - 1)]
    got = C.score_phrases(spark.createDataFrame(rows, "lang string, phrase string, words int, f long")).collect()
    assert [r.score for r in got] == [2_000_000 * (big - 1) // (2 * big + 7)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_query_matches_sql(spark):
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = C.op11_collocations(spark, d)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({C.OP11_SQL})").fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
