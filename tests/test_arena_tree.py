"""Successors of an arena and the audit of chains."""

from strataline.operators import graph as G

EDGES = [("a", "t", 2), ("b", "t", 1), ("c", "a", 1), ("c", "b", 2), ("c", "x", 0), ("d", "c", 1), ("x", "d", 1), ("t", "a", 1)]
STATES = [("t", 0), ("a", 1), ("b", 1), ("c", 2), ("d", 3), ("x", 4)]


def frames(spark):
    return spark.createDataFrame(STATES, "node string, distance long"), spark.createDataFrame(EDGES, "source string, target string, pos int")


def test_the_first_nearer_node_is_next(spark):
    states, edges = frames(spark)
    by_name = {r.node: r.next for r in G.shortest_next(states, edges, []).collect()}
    assert by_name == {"t": None, "a": "t", "b": "t", "c": "a", "d": "c", "x": "d"}
    later = edges.withColumn("pos", -edges.pos)
    assert {r.node: r.next for r in G.shortest_next(states, later, ["pos"]).collect()}["c"] == "b"


def test_chains_and_their_errors(spark):
    states, edges = frames(spark)
    chains = G.shortest_chains(G.shortest_next(states, edges, []), 5)
    assert {r.node: ">".join(r.chain) for r in chains.collect()} == {"t": "t", "a": "a>t", "b": "b>t", "c": "c>a>t", "d": "d>c>a>t", "x": "x>d>c>a>t"}
    assert all(r.errors == [] for r in G.chain_errors(chains, edges, states).collect())
    wrong = spark.createDataFrame([("t", 0, ["t"]), ("a", 1, ["a"]), ("c", 2, ["c", "t"]), ("d", 3, ["d", "c", "x", "t"]), ("x", 4, ["x", "d", "c", "b"])], "node string, distance long, chain array<string>")
    told = {r.node: r.errors for r in G.chain_errors(wrong, edges, states).collect()}
    assert told == {"t": [], "a": ["length", "end"], "c": ["length", "edge", "distance"], "d": ["edge", "distance"], "x": ["length", "end"]}
    assert G.shortest_chains(G.shortest_next(states.limit(0), edges, []), 2).count() == 0
    short = {r.node: ">".join(r.chain) for r in G.shortest_chains(G.shortest_next(states, edges, []), 1).collect()}
    assert short["x"] == "x>d" and short["a"] == "a>t"
