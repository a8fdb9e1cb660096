"""Aliases and secrets found by the automaton, against one search for each pattern."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strataline.functions import text as X
from strataline.operators import patterns as P

ALIASES = [(1, "an"), (2, "Anna"), (3, "anna b"), (4, "É"), (5, "an"), (6, None), (7, ""), (8, "x.y"), (9, "日本"), (10, "a"), (11, "İ"), (12, r"\E"), (13, "AN"), (14, "_")]


def texts():
    rng = random.Random(6)
    bits = ["an", "Anna", " ", "B", "é", "É", "x.y", "xzy", "日本", "本", "_", "-", "İ", "ı", r"\E", "1", "ß", "\n"]
    return [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(80)] + [(80, None), (81, ""), (81, "Anna Anna"), (None, "anna"), (82, "an " * 100_000)]


def plain(whole_word):
    out = []
    for key, text in texts():
        low = P.fold_case(text or "")
        for number, alias in ALIASES:
            if not alias:
                continue
            starts = [m.start() for m in re.finditer(f"(?={re.escape(P.fold_case(alias))})", low)]
            end = len(P.fold_case(alias))
            if whole_word:
                edge = lambda at: 0 <= at < len(low) and (low[at].isalnum() or low[at] == "_")  # noqa: B023, E731
                starts = [s for s in starts if not edge(s - 1) and not edge(s + end)]
            if starts:
                out.append((key, number, len(starts), starts[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("whole_word", [True, False])
@pytest.mark.parametrize("size", [P.PATTERN_BYTES, 12])
def test_matches_one_search_for_each_pattern(spark, monkeypatch, whole_word, size):
    monkeypatch.setattr(P, "PATTERN_BYTES", size)
    t = spark.createDataFrame(texts(), "id long, text string").repartition(3)
    a = spark.createDataFrame(ALIASES, "alias_id long, alias string")
    got = P.find_patterns(t, a, ["id"], "text", "alias_id", "alias", whole_word)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(whole_word)
    counted = P.count_patterns(t.withColumn("_k0", F.lit(1)), a, "text", "alias", "n", whole_word)
    assert counted.columns == ["id", "text", "_k0", "n"]
    distinct = {}
    for key, number, _, _ in plain(whole_word):
        distinct.setdefault(key, set()).add(dict(ALIASES)[number])
    found = counted.where("id < 81").collect()
    assert {r.id: r.n for r in found} == {k: len(distinct.get(k, ())) for k in range(81)}


def test_no_cross_join_and_no_text_in_a_shuffle(spark):
    t = spark.createDataFrame(texts(), "id long, text string")
    plan = P.find_patterns(t, spark.createDataFrame(ALIASES, "alias_id long, alias string"), ["id"], "text", "alias_id", "alias")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "_text" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_empty_sides(spark):
    t, a = spark.createDataFrame(texts(), "id long, text string"), spark.createDataFrame(ALIASES, "alias_id long, alias string")
    assert P.find_patterns(t.limit(0), a, ["id"], "text", "alias_id", "alias").count() == 0
    assert P.find_patterns(t, a.limit(0), ["id"], "text", "alias_id", "alias").count() == 0
    assert {r.n for r in P.count_patterns(t, a.limit(0), "text", "alias", "n").collect()} == {0}


@pytest.mark.parametrize(
    "text,alias,direct",
    [
        ("Alice", "alice", True), ("alice!", "Alice", True), ("The answer is 'Alice'.", "Alice", True), ("Answer: alice", "Alice", True), ("It was  Alice", "Alice", True), ("My final answer is Alice.", "Alice", True),
        ("not Alice", "Alice", False), ("the page mentions Alice", "Alice", False), ("Alice B", "Alice", False), ("a.b", "a.b", True), ("axb", "a.b", False), (r"x\Ey", r"x\Ey", True), ("", "", False), ("Ärger", "ärger", True), ("Alice or Bob", "Alice", False),
    ],
)
def test_direct_answers(spark, text, alias, direct):
    row = spark.createDataFrame([(text, alias)], "t string, a string").select(X.answers_directly(F.col("t"), F.col("a")).alias("d"), X.mentions(F.col("t"), F.col("a")).alias("m")).first()
    assert row.d == direct and (row.m or not direct)
