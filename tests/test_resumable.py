"""The search that stops and goes on, against one loop over a queue."""

import random
from collections import deque

import pytest

from strataline.operators import resumable as R


def graph(seed, n):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.randrange(3)) for _ in range(4 * n)]


def plain(edges, start, depth, branch, most):
    out = {}
    for s, t, k in sorted(set(edges), key=lambda e: (e[0], e[2], e[1])):
        out.setdefault(s, []).append(t)
    found, queue = {}, deque()
    for s in start:
        found[s] = (len(found), 0, None)
        queue.append(s)
    while queue:
        node = queue.popleft()
        if found[node][1] < depth:
            for t in out.get(node, [])[:branch]:
                if t not in found and len(found) < most:
                    found[t] = (len(found), found[node][1] + 1, node)
                    queue.append(t)
    return sorted((n, *x) for n, x in found.items())


@pytest.mark.parametrize(("budgets", "most", "chunk"), [((1000,), 1000, 10_000), ((1, 2, 5, 1000), 1000, 10_000), ((7, 0, 9, 1000), 23, 4), ((30, 1000), 1000, 3)])
def test_any_budgets_give_the_same_table(spark, tmp_path, monkeypatch, budgets, most, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    edges = graph(3, 40)
    df = spark.createDataFrame(edges, "source long, target long, kind int").distinct()
    reports = []
    for budget in budgets:
        nodes, report = R.resume_search(df, ["kind"], [5, 9], f"{tmp_path}/s", 3, 2, most, budget)
        reports.append(report)
    want = plain(edges, [5, 9], 3, 2, most)
    assert sorted(map(tuple, nodes.collect())) == want and reports[-1]["status"] == "complete" and reports[-1]["lower_bound"] is None
    assert reports[-1]["cap_reached"] == (len(want) == most < len(plain(edges, [5, 9], 3, 2, 10_000)))
    full = {n: depth for n, _, depth, _ in want}
    for report in reports[:-1]:  # a node that was not found by then is not nearer than the bound
        known = report["nodes"]
        assert all(depth >= report["lower_bound"] for n, o, depth, _ in want if o >= known) and report["frontier"] == known - report["expanded"]
    assert max(full.values()) <= 3


def test_a_run_that_dies_has_done_nothing(spark, tmp_path, monkeypatch):
    edges = spark.createDataFrame(graph(8, 30), "source long, target long, kind int").distinct()
    go = lambda budget, path: R.resume_search(edges, ["kind"], [1], path, 4, 3, 500, budget)
    go(4, f"{tmp_path}/a")
    monkeypatch.setattr(R, "_save", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        go(5, f"{tmp_path}/a")
    monkeypatch.undo()
    one, two = go(1000, f"{tmp_path}/a")[0], go(1000, f"{tmp_path}/b")[0]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    with pytest.raises(ValueError, match="other parameters"):
        R.resume_search(edges, ["kind"], [1], f"{tmp_path}/a", 4, 2, 500, 1)


def test_nothing_to_search(spark, tmp_path):
    edges = spark.createDataFrame([], "source string, target string")
    nodes, report = R.resume_search(edges, [], ["x"], f"{tmp_path}/s", 3, 3, 10, 10)
    assert [tuple(r) for r in nodes.collect()] == [("x", 0, 0, None)] and report["status"] == "complete"
