"""What a plan must not do at size, on small tables with results known by hand."""

import datetime as dt

import pytest

from strataline.plans import jn


@pytest.fixture(scope="module")
def moves(spark, tmp_path_factory):
    """Two movers to holder 2, whom two others, and the first mover, hold on the cutoff day; one move and one hold come twice."""
    folder = str(tmp_path_factory.mktemp("moves"))
    t = lambda day, h=0: dt.datetime(2024, 1, day, h)
    rows = [(0, t(2), 1, "purchase", 1), (1, t(12), 1, "purchase", 2), (2, t(12, 1), 1, "purchase", 1), (3, t(12, 2), 1, "purchase", 2), (4, t(3), 5, "purchase", 7), (5, t(15), 5, "purchase", 2)]
    rows += [(6, t(9), 8, "view", 2), (7, t(10), 8, "view", 2), (8, t(9), 9, "view", 2), (9, t(9), 1, "view", 2), (10, t(11), 4, "view", 2)]
    frame = spark.createDataFrame([(*r[:4], 1.0, f'{{"k": {r[4]}}}') for r in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.write.parquet(f"{folder}/events.parquet")
    return folder


def test_anchor_join_forms_its_pairs_once(spark, moves):
    found = jn.jn06(spark, moves)
    day = lambda d: dt.date(2024, 1, d)
    got = sorted(map(tuple, found.collect()))
    assert got == [(1, 2, 8, day(12)), (1, 2, 9, day(12)), (5, 2, 1, day(15)), (5, 2, 8, day(15)), (5, 2, 9, day(15))]
    # the pairs are many times the input: nothing may shuffle or compare them after the join
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join Inner")]
