import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from strataline.llm import importance as I
from strataline.llm.shared import fresh, numbered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, most):
    words = WORD.findall((text or "").translate(UPPER))
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, items, most, buckets, percent, least, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source, target = (Counter(bucket(f) for _, t in rows for f in plain_features(t, most)[1]) for rows in (docs, items))
    s_all, t_all = sum(source.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets))))
    out = []
    for i, t in docs:
        words, found = plain_features(t, most)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


DOCS = [
    (0, None), (1, ""), (2, "One two, one TWO three"), (3, "a" * 5_000 + " b"), (4, "É é ünï 日本語 words " * 9), (5, "..."), (6, "Ab" * 1_100),
    (7, "goal words here " * 20), (7, "goal words here " * 20), (7, "goal words"), (None, "target words " * 30), (8, "x " * 200_000 + "y"), (9, "end"), (10, "next" * 2),
    *[(100 + i, " ".join(f"w{(i * k) % 17}" for k in range(i % 40))) for i in range(80)],
]
ITEMS = [(1, "goal words here"), (2, None), (3, "é Target words"), (4, "")]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_matches_brute_force(spark, most):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in DOCS], "doc_id long, text string, able string, n_words int, place int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = I.resample(docs, items, carry=("able", "place"), most=most, buckets=97, percent=33, least_words=3, seed=5)
    assert got.columns == ["doc_id", "able", "place", "n_words", "n_features", "weight", "score", "rank"]
    rows = got.collect()
    assert all(r.able == "x" and r.place == 2 for r in rows)
    assert sorted(((r[0], *r[3:]) for r in rows), key=repr) == brute(DOCS, ITEMS, most, 97, 33, 3, 5)


def test_crc_and_spans():
    data = np.frombuffer("ab cd".encode() + b"x" * 10_000 + "é1".encode(), np.uint8)
    starts, ends = np.array([0, 3, 3, 2, 4, 10_000]), np.array([2, 5, len(data), 2, 9_999, len(data)])
    assert I.crc_of_spans(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert len(I.crc_of_spans(data, starts[:0], ends[:0])) == 0
    got = I.word_spans(np.frombuffer(b"abcd", np.uint8), np.array([0, 0, 2, 2]))
    assert [x.tolist() for x in got] == [[0, 2], [2, 4]]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert I.resample(docs.limit(0), items).count() == 0
    assert I.resample(docs, items.limit(0)).count() == len(DOCS)
    assert I.resample(docs.limit(0), items.limit(0)).count() == 0


def test_no_task_gets_all_rows_and_numbers_are_in_order(spark):
    rows = spark.range(5_000).selectExpr("id", "id % 3 AS part", "CAST(NULL AS string) AS at", "CASE WHEN id % 5 > 0 THEN id % 2 END AS g")
    got = numbered(rows, [rows.id.desc()], "place", "test", by=("g",)).toPandas()
    assert list(got.columns) == ["id", "part", "at", "g", "place"]
    for _, own in got.groupby("g", dropna=False):
        assert own.sort_values("id", ascending=False)["place"].tolist() == list(range(1, len(own) + 1))
    assert fresh(rows, "At", "part", "part", "new") == ("_At", "_part", "__part", "new")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_query_matches_sql(spark):
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({I.OP13_SQL})").fetchall()
    got = I.op13_importance_resampling(spark, d)
    assert got.columns == columns and {k for _, k in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
