import datetime as dt
import hashlib
import math
import random
from fractions import Fraction

import pandas as pd
import plain_samplers as PS
import pytest
from pyspark.sql import functions as F

from strataline.functions import labels as LB
from strataline.functions import text as X
from strataline.operators import analytics as A
from strataline.operators import graph as G
from strataline.operators import joins as J
from strataline.operators import ordering as O
from strataline.operators import procedural as P
from strataline.operators import temporal as T
from strataline.sources import log as L
from strataline.streaming import log as S

D = dt.date


def test_mcnemar_golden_values(spark):
    rows = spark.createDataFrame([(1, 4), (5, 3), (0, 4), (0, 0)], "b int, c int")
    assert [r.p if r.p is None else round(r.p, 7) for r in rows.select(A.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()] == [0.375, 0.7265625, 0.125, None]


def test_mcnemar_and_binomial_of_many_trials(spark):
    """Over 1,029 trials the coefficients pass the range of doubles; held against whole numbers."""
    pairs = [(2000, 2003), (1950, 2050), (2050, 1951), (2000, 2000), (0, 5000), (515, 514)]

    def exact(b, c):
        n, own = b + c, math.comb(b + c, b)
        return float(Fraction(sum(x for x in (math.comb(n, k) for k in range(n + 1)) if x <= own), 2**n))

    rows = spark.createDataFrame(pairs, "b int, c int").coalesce(1)
    got = rows.select(A.mcnemar(F.col("b"), F.col("c")).alias("p"), A.binomial_pmf(F.col("b"), F.col("b") + F.col("c")).alias("pmf")).collect()
    assert [r.p for r in got] == pytest.approx([exact(*x) for x in pairs], rel=1e-10, abs=1e-9)
    assert [r.pmf for r in got] == pytest.approx([float(Fraction(math.comb(b + c, b), 2 ** (b + c))) for b, c in pairs], rel=1e-9)


def test_percent_rounds_half_to_even(spark):
    got = spark.createDataFrame([(1, 16), (5, 13), (0, 0)], "s int, n int").select(A.percent(F.col("s"), F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [6.2, 38.5, None]


def test_ambiguity_gives_nothing(spark):
    rows = spark.createDataFrame([(1, D(2024, 1, 2), "a"), (1, D(2024, 1, 2), "b"), (1, D(2024, 1, 3), "c"), (2, D(2024, 1, 2), "a"), (2, D(2024, 1, 2), "a"), (3, None, "z")], "k int, day date, target string")
    assert [(r.k, r.target) for r in T.first_unique(rows, ["k"], "day", "target").collect()] == [(2, "a")]


@pytest.mark.parametrize(
    "days,expect",
    [([(2, "p"), (3, "x")], ["x"]), ([(2, "p"), (3, "x"), (3, "y"), (4, "z")], []), ([(2, "x"), (3, "y"), (3, "z")], ["x"]), ([(2, "p")], []), ([], [])],
)
def test_next_unique_passes_over_the_previous_target(spark, days, expect):
    rows = spark.createDataFrame([(1, "p", D(2024, 1, d), t) for d, t in days], "k int, previous string, day date, target string")
    assert [r.target for r in T.next_unique(rows, ["k"], "day", "target", "previous").collect()] == expect


def test_as_of_takes_the_last_version_and_breaks_ties(spark):
    v = spark.createDataFrame([(1, 10, 5), (1, 10, 6), (1, 20, 7), (2, 99, 8)], "page int, ts int, id int")
    p = spark.createDataFrame([(1, 9), (1, 10), (1, 19), (1, 25), (2, 1), (3, 5)], "page int, at int")
    got = {(r.page, r["at"]): r.version and r.version.id for r in T.as_of(p, v, "page", "at", "ts", "id").collect()}
    assert got == {(1, 9): None, (1, 10): 6, (1, 19): 6, (1, 25): 7, (2, 1): None, (3, 5): None}


def test_even_sample_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(1, i) for i in range(6)] + [(2, 4)], "k int, v int")
    assert sorted((r.k, r.v) for r in O.even_sample(rows, ["k"], "v", 3).collect()) == [(1, 0), (1, 2), (1, 5), (2, 4)]
    assert sorted((r.k, r.v) for r in O.even_sample(rows, ["k"], "v", 1).collect()) == [(1, 5), (2, 4)]


def test_first_and_last_wins(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, None)], "k string, n int, v string")
    assert sorted((r.k, r.v) for r in O.first_wins(rows, ["k"], ["n"]).collect()) == [("a", "x"), ("b", None)]
    assert sorted((r.k, r.v) for r in O.last_wins(rows, ["k"], "n").collect()) == [("a", "y"), ("b", None)]


def test_bfs_on_a_cycle_and_cap_before_seen(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3)], "source long, target long")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert sorted((r.node, r.distance) for r in G.distances(edges, seeds, 5).collect()) == [(1, 0), (2, 1), (3, 1)]
    links = spark.createDataFrame([(2, 1, 0), (2, 9, 1)], "source long, target long, pos long")
    assert [r.target for r in G.cap_links(links, "source", ["pos"], 1).collect()] == [1]


def test_arena_switches_versions_and_reports_truncation(spark):
    links = spark.createDataFrame([(0, 2, 1), (1, 3, 2)], "version long, source long, target long")
    versions = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 1)], "page long, version long")
    target = spark.createDataFrame([(1, 0)], "page long, version long")
    states, edges, cut = G.arena(links, versions, target, 3, 100)
    assert {r.node: r.distance for r in states.collect()} == {"0:1": 0, "0:2": 1, "1:2": 2, "1:3": 3} and not cut
    assert G.arena(links, versions, target, 3, 2)[2]


def test_version_pairs_of_large_titles_are_members(spark):
    rows = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 7), (2, 8), (2, 8), (3, 9)], "page int, v int")
    small = {(2, 7, 8), (2, 8, 7)}
    got = J.version_pairs(rows, "page", "v", 5)
    assert {tuple(r) for r in got.collect()} == small | {(1, i, j) for i in range(5) for j in range(5) if i != j} and got.count() == 22
    got = J.version_pairs(rows, "page", "v", 4)
    assert {tuple(r) for r in got.collect()} == small | {(1, i, None) for i in range(5)} and got.count() == 7
    assert J.version_pairs(rows.limit(0), "page", "v", 4).count() == 0


def test_text_functions(spark):
    row = spark.createDataFrame([("a%20b_c+d", "[[Page|Straße]] ＡＢ", "2024-02-30", "+2023-00-11T00:00:00Z", "X", 'see ```{"k": 3}```')], "t string, f string, d string, l string, x string, j string")
    got = row.select(X.normalise_title(F.col("t")).alias("t"), X.fold("f").alias("f"), X.strict_date(F.col("d")).alias("d"), X.time_literal(F.col("l")).alias("l"), X.lenient_json(F.col("j"), "k int").alias("j"), X.mentions(F.lit("in Übung macht"), F.lit("übung")).alias("m")).first()
    assert (got.t, got.f, got.d, got.l, got.j.k, got.m) == ("a b c+d", "strasse ab", None, None, 3, True)


def test_page_blocks_and_diff():
    content, links = P.page_blocks('<nav><p>no</p></nav><h1>T</h1><p>a <a href="/X_y">b&amp;c</a> d</p><div>out</div><li>e</li>')
    assert content == "T\n\na b&c d\n\ne" and links == [{"target": "X_y", "anchor": "b&c"}]
    assert P.block_diff("a\n\nb\n\nc", "a\n\nx\n\nc") == (["b"], ["x"], ["a", "c"])


def test_samplers_respect_caps():
    p = pd.DataFrame({"id": range(40), "grp": 0, "family": ["f%d" % (i % 4) for i in range(40)], "property": [i % 10 for i in range(40)], "source": [i % 5 for i in range(40)], "views": [i * 7 % 40 for i in range(40)], "score": [float(i) for i in range(40)]})
    got = PS.diverse_by_popularity(p, 12, 3, 2, 3)
    assert len(got) == 12 and got.family.value_counts().max() <= 3 and got["property"].value_counts().max() <= 2
    assert list(PS.diverse_by_coverage(p, 4, {"source": 1}).family.unique()) == ["f3", "f2", "f1", "f0"]
    assert PS.capped_round_robin(p, 8, "family", {"source": 2}).source.value_counts().max() <= 2


def test_pheromones():
    steps = pd.DataFrame({"run": 1, "step": [1, 2], "edge": ["a", "b"], "reward": [1.0, -0.5]})
    got = dict(P.pheromones(steps)[["edge", "pheromone"]].itertuples(index=False))
    assert math.isclose(got["a"], (0.85 + 1) * 0.85) and math.isclose(got["b"], 0.85 - 0.5)


def test_bootstrap_is_seeded(spark):
    cells = spark.createDataFrame([("m", 11, 35), ("n", 0, 0)], "model string, successes long, n long")
    a, b = (sorted(map(tuple, A.bootstrap(cells, ["model"]).collect())) for _ in range(2))
    assert a == b and a[1][3:] == (None, None) and 12 < a[0][3] < 22 and 43 < a[0][4] < 53


def test_log_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n{bad\n\n{"k": 3}\n')
    got = sorted((r.line_no, r.k, r.corrupt) for r in L.read_lines(spark, f"{tmp_path}/a.jsonl", "k int").collect())
    assert got == [(1, 1, None), (2, None, "{bad"), (4, 3, None)]
    with pytest.raises(Exception):
        L.read_lines(spark, f"{tmp_path}/a.jsonl", "k int", fail_fast=True).collect()
    df = spark.createDataFrame([(1, "x")], "k int, slot string")
    L.append_new(df, f"{tmp_path}/out", ["slot"])
    with pytest.raises(Exception):
        L.append_new(df, f"{tmp_path}/out")
    L.write_scores(df, f"{tmp_path}/scores")
    assert spark.read.csv(f"{tmp_path}/scores", header=True).count() == 1


def test_ledger_merge(spark):
    old = spark.createDataFrame([("a", 2, 5, "pending"), ("b", 1, 1, "rejected")], "fingerprint string, attempts long, first_seen long, status string")
    new = spark.createDataFrame([("a", 9, "passed", 2), ("a", 8, "failed", 1), ("c", 7, "pending", 3)], "fingerprint string, seen long, status string, line_no long")
    got = sorted(map(tuple, L.ledger_merge(old, new).collect()))
    assert got == [("a", 4, 5, "passed"), ("b", 1, 1, "rejected"), ("c", 1, 7, "pending")]


def test_streams_match_batches(spark, tmp_path):
    schema = "key string, line_no long, label string, ts timestamp"
    rows = [(f"k{i % 4}", i, "abc"[i % 3], dt.datetime(2024, 1, 1, 0, i)) for i in range(30)]
    batch = spark.createDataFrame(rows, schema)
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = S.latest_per_key(stream(), ["key"], "line_no", ["label"]).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, O.last_wins(batch.drop("ts"), ["key"], "line_no").collect()))
    assert sorted(map(tuple, spark.table("latest").collect())) == want
    q = S.once_per_key(stream(), ["key"], "ts", "1 day").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.key for r in spark.table("once").collect()) == ["k0", "k1", "k2", "k3"]
    spark.createDataFrame([("k1",)], "key string").write.parquet(f"{tmp_path}/done")
    q = S.resumable(stream(), f"{tmp_path}/check", lambda: spark.read.parquet(f"{tmp_path}/done"), ["key"], lambda b: b.write.mode("append").parquet(f"{tmp_path}/out"))
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").where("key = 'k1'").count() == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 30 - 8


def test_pheromones_of_a_long_run(spark):
    n = 100_050
    steps = spark.range(n).selectExpr("if(id < 20, 2, 1) as run", "id as step", "id * id % 7 as edge", "if(id % 3 = 0, -0.5D, 0.2D) as reward").repartition(3)
    frame = steps.toPandas()
    expect = {tuple(r) for run in (1, 2) for r in P.pheromones(frame[frame["run"] == run]).itertuples(index=False)}
    assert {tuple(r) for r in P.replay_pheromones(steps).collect()} == expect


def test_greedy_pool_loses_nothing(spark):
    """The greedy picks from the pool are those from all rows."""
    rng = random.Random(3)
    rows = [(i, 0, rng.choice(["a", "a", "a", "b", "c"]), rng.choice([1, 1, 1, 2, 3, 4, 5]), rng.choice([1, 1, 2, 3, 4, 5, 6, 7]), rng.randint(0, 9), float(rng.randint(0, 5))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, grp int, family string, property long, source long, views long, score double").withColumn("_place", -F.col("id"))
    whole = df.drop("_place").toPandas()
    total = 6
    for order, each, pick in (
        (["views", "id"], 2, lambda p: PS.diverse_by_popularity(p, total, 3, 3, 2)),
        (["score", "id"], 2, lambda p: PS.diverse_by_coverage(p, total, {"source": 2, "family": 3, "property": 3})),
        (["_place"], 1, lambda p: PS.capped_round_robin(p, total, "family", {"source": 1, "property": 2})),
    ):
        pool = P.greedy_pool(df, total, each, order).drop("_place").toPandas()
        assert len(pool) < len(whole) / 4 and list(pick(pool)["id"]) == list(pick(whole)["id"])


def test_samplers_equal_the_plain_picks_for_any_number_of_families(spark):
    rng = random.Random(11)
    rows = [(i, f"f{rng.randrange(40)}" if i % 50 else None, rng.randrange(9), rng.randrange(30), rng.randrange(60), float(rng.randrange(9))) for i in range(4_000)]
    df = spark.createDataFrame(rows, "id long, family string, property long, source long, views long, score double")
    whole, total = df.toPandas(), 9
    ids = lambda found: [r.id for r in sorted(found.collect(), key=lambda r: r.place)]
    filled = whole.assign(family=whole["family"].where(whole["family"].notna(), "none"))
    assert ids(P.greedy_pick(df, total, {"family": 2, "property": 2, "source": 1}, P.by_popularity)) == list(PS.diverse_by_popularity(filled, total, 2, 2, 1)["id"])
    assert ids(P.greedy_pick(df, total, {"source": 2, "family": 3, "property": 2}, P.by_coverage)) == list(PS.diverse_by_coverage(filled, total, {"source": 2, "family": 3, "property": 2})["id"])
    few = df.where("family in ('f1', 'f2')")
    for caps, data, most in (({"source": 1, "property": 2}, df, total), ({"source": 1, "property": 1}, few, 30)):
        assert ids(P.capped_round_robin(data, most, "family", caps)) == list(PS.capped_round_robin(data.where("family is not null").toPandas(), most, "family", caps)["id"])
    assert P.greedy_pick(df.limit(0), 3, {"family": 1}, P.by_popularity).count() == 0 == P.capped_round_robin(df.limit(0), 3, "family", {}).count()


def test_popularity_ties_go_to_views_then_the_greatest_id():
    p = pd.DataFrame({"id": [1, 2, 3, 4], "family": list("aabb"), "property": 1, "source": [1, 2, 3, 4], "views": [0, 1, 1, 0]})
    assert list(PS.diverse_by_popularity(p, 4, 9, 9, 9)["id"])[:2] == [3, 2]


def plain_ants(edges, starts, seed, ants, steps):
    """Ants one after the other, by dicts."""
    out = []
    for run, start in starts:
        level = {}
        for ant in range(ants):
            seen, gains = [start], []
            for k in range(steps):
                open_ = [e for e in edges if e[0] == seen[-1] and e[1] not in seen]
                if not open_:
                    break

                def value(e):
                    h = hashlib.sha256(f"{seed}|{run}|{ant}|{k}|{e[1]}".encode()).hexdigest()
                    u = (int(h[:13], 16) + 0.5) / 2**52
                    return (e[2] + math.log(level.get(e[:2], 1.0)) + e[3] - math.log(-math.log(u)), e[1])

                best = max(open_, key=value)
                seen.append(best[1])
                gains.append(best[2])
            reward = sum(gains) / len(gains) if gains else 0.0
            level = {e: max(0.05, x * 0.85) for e, x in level.items()}
            for distance, e in enumerate(list(zip(seen, seen[1:]))[::-1][:4]):
                level[e] = min(5.0, max(0.05, level.get(e, 1.0) + reward * 0.6**distance))
            out.append((run, ant, len(gains), ">".join(map(str, seen[1:])), round(reward, 6)))
    return sorted(out)


def test_ant_search_equals_ants_one_by_one(spark):
    rng = random.Random(5)
    edges = [(a, b, rng.randint(0, 9) / 10, rng.randint(0, 9) / 10) for a in range(12) for b in rng.sample(range(14), 3) if a != b]
    starts = [(7, 0), (8, 3), (9, 13)]
    got = P.ant_search(spark.createDataFrame(edges, "source long, target long, score double, heuristic double"), spark.createDataFrame(starts, "run long, start long"), "s", ants=3, steps=3)
    assert sorted(map(tuple, got.collect())) == plain_ants(edges, starts, "s", 3, 3)


def test_lines_are_numbered_over_splits(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 10)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{k}" + "x" * (k % 50) + "\n" for k in range(1, n + 1)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
        got = L.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(got) == 3010 and all(r.line.rstrip("x") == f"{r.file[-5]}{r.line_no}" for r in got)


def test_leaks_are_literal(spark):
    texts = spark.createDataFrame([(1, "xThe secret of THE seamstress"), (2, "the  secret of the sea"), (3, "nothing. one, two"), (4, None), (5, "")], "id long, text string")
    secrets = spark.createDataFrame([("a", "the secret of the sea"), ("b", "One, Two"), ("c", "one two three"), ("d", None)], "key string, secret string")
    assert sorted(map(tuple, LB.leaks(texts, secrets, "id", "text", "key", "secret").collect())) == [(1, "a"), (3, "b")]


def test_document_replaced_whole(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/d.json"
    read = lambda: [r.k for r in L.read_document(spark, path, "k int").collect()]
    assert L.read_document(spark, path, "k int") is None
    began = None
    for k in (1, 2, 3, 4):
        L.replace_document(spark.createDataFrame([(k,)], "k int"), path)
        assert read() == [k] and len(list((tmp_path / "d.json").iterdir())) <= 2
        assert began is None or [r.k for r in began.collect()] == [k - 1]  # a reader that has begun sees the version before
        began = L.read_document(spark, path, "k int")
    with pytest.raises(FileExistsError):
        L.replace_document(spark.createDataFrame([(5,)], "k int"), path, refuse=True)
    with pytest.raises(Exception, match="no such column|UNRESOLVED|cannot"):  # a writer that dies leaves the old one
        L.replace_document(spark.createDataFrame([(5,)], "k int").select(F.raise_error(F.lit("cannot")).alias("k")), path)
    assert read() == [4]
    # another writer takes the number in between
    known = L._versions(spark, path)
    monkeypatch.setattr(L, "_versions", lambda *_: known[:-1])
    L.replace_document(spark.createDataFrame([(6,)], "k int"), path)
    monkeypatch.undo()
    assert read() == [6]
    with pytest.raises(ValueError):
        L.append_more(spark.createDataFrame([(3,)], "k int"), f"{tmp_path}/none")


def test_search_keeps_terminal_states_and_stops_at_the_budget(spark):
    links = spark.createDataFrame([(1, 2, 1, -1), (1, 3, 2, -2), (2, 1, 1, -1), (3, 4, 1, -9)], "source long, target long, place long, gain long")
    start, answers = spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(3,)], "node long")
    rows = lambda df: sorted((tuple(r.path), r.shown, r.status, r.score, r.final) for r in df.collect())
    # page 2 leads back only, page 3 submits or goes on to page 4, which has no links
    assert rows(G.search(start, links, answers, 10, 5, 100, "s", submit_gain=-3)) == [((1, 2), 0, "exhausted", -1, False), ((1, 3), 0, "submitted", -5, True), ((1, 3, 4), 0, "exhausted", -11, False)]
    assert rows(G.search(start, links, answers, 10, 5, 1, "s")) == [((1, 2), 0, "open", -1, True)]
    assert rows(G.search(start, links, answers, 10, 5, 0, "s")) == [((1,), 0, "open", 0, True)]
    # with pages of one link, a state whose actions all lead back is not kept
    got = rows(G.search(start, links, answers, 10, 5, 3, "s", page_rows=1, list_gain=-1, keep_blocked=False))
    assert got == [((1,), 2, "open", -2, True), ((1, 2), 0, "open", -2, False)]
    assert rows(G.search(start.where("false"), links, answers, 10, 5, 3, "s")) == []


def test_chains_take_single_next_facts_within_the_caps(spark):
    day = lambda n: D(2024, 1, n)
    facts = spark.createDataFrame(
        [(1, "a", 2, day(1)), (2, "a", 3, day(6)), (2, "a", 9, day(8)), (2, "b", 4, day(7)), (2, "b", 5, day(7)), (2, "c", 1, day(6)), (3, "b", 6, day(9)), (3, "a", 7, day(9))],
        "source long, property string, target long, at date",
    )
    rates = spark.createDataFrame([("a", "x", 10), ("b", "y", 20), ("c", "x", 5)], "property string, family string, rate long")
    got = G.discover_chains(facts, rates, facts, "2024-01-05", 3, 10, 5, 2, 1, 300, "s").collect()
    # b is ambiguous at page 2, c leads back, a third a is over the cap
    assert sorted((tuple(r.path), tuple(r.properties), r.score) for r in got) == [((1, 2, 3), ("a", "a"), 320), ((1, 2, 3, 6), ("a", "a", "b"), 640)]
    assert G.discover_chains(facts, rates, facts.where("target <> 6"), "2024-01-05", 3, 10, 5, 2, 2, 300, "s").collect() == []


def test_blocks_are_stripped(spark):
    text = "  0 first block, two\nlines \n \t \n1 second block of text 1\n\n   short    \n\x0b\n\n a third one, longer still\r"
    got = spark.createDataFrame([(text,)], ["t"]).select(X.blocks(F.col("t")).alias("b")).first()
    assert got.b == ["0 first block, two\nlines", "1 second block of text 1", "a third one, longer still"]
