"""The as-of join with split keys, against a plain search."""

import datetime as dt
import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from strataline.operators import temporal as T

BASE = dt.datetime(2020, 1, 1)


def rows(seed, n, pages):
    rng = random.Random(seed)
    page = lambda: 0 if rng.random() < 0.5 else rng.randrange(pages)  # noqa: E731  one page has half of all revisions
    when = lambda: None if rng.random() < 0.05 else BASE + dt.timedelta(hours=rng.randrange(3_000) * 24)
    versions = [(page(), when(), k, f"v{k}") for k in range(n)] + [(None, BASE, n, "nobody")]
    points = [(page(), when(), k) for k in range(n // 2)] + [(None, BASE, n), (pages + 1, BASE, n + 1)]
    return versions, points


def plain(versions, points):
    known = {}
    for page, ts, k, _ in versions:
        if page is not None and ts is not None:
            known.setdefault(page, []).append((ts, k))
    for own in known.values():
        own.sort()
    out = {}
    for page, at, k in points:
        own = known.get(page, []) if at is not None else []
        n = bisect_right(own, (at, float("inf"))) if own else 0
        out[k] = own[n - 1][1] if n else None
    return out


@pytest.mark.parametrize("days", [1, 32, 10_000])
def test_matches_a_plain_search(spark, days):
    versions, points = rows(days, 600, 20)
    v = spark.createDataFrame([(*x, "a") for x in versions], "page long, ts timestamp, id long, name string, version string")
    p = spark.createDataFrame([(*x, "b") for x in points], "page long, at timestamp, k long, name string")
    got = T.as_of(p, v, "page", "at", "ts", "id", days)
    assert got.columns == ["page", "at", "k", "name", "version"] and got.schema["version"].dataType == v.schema
    found = got.collect()
    assert {r.k: r.version and r.version.id for r in found} == plain(versions, points) and len(found) == len(points)
    assert all(r.name == "b" and (r.version is None or (r.version.version == "a" and r.version.page == r.page and r.version.ts <= r["at"])) for r in found)


def test_empty_sides(spark):
    v = spark.createDataFrame([], "page long, ts timestamp, id long")
    p = spark.createDataFrame([(1, BASE, 1)], "page long, at timestamp, k long")
    assert [r.version for r in T.as_of(p, v, "page", "at", "ts", "id").collect()] == [None]
    assert T.as_of(p.limit(0), v, "page", "at", "ts", "id").count() == 0


def test_a_page_with_half_of_all_revisions_is_spread(spark):
    """No window or join of the plan is dealt by the page alone, but for the one row of each stretch."""
    rows_ = spark.range(4_000).select((F.col("id") % 2 * F.col("id")).alias("page"), F.timestamp_seconds(F.col("id") * 86_400).alias("ts"), "id")
    points = rows_.select("page", F.col("ts").alias("at"))
    plan = T.as_of(points, rows_, "page", "at", "ts", "id")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    alone = [line for line in dealt if "_stretch" not in line]
    assert dealt and len(alone) == 1  # the last versions of the stretches
    spread = rows_.where("page = 0").select(F.floor(F.unix_seconds("ts") / (32 * 86_400)).alias("s")).distinct().count()
    assert spread >= 60
