"""Nested values of unknown depth, against a walk in Python."""

import json
import random

from pyspark.sql import functions as F

from strataline.operators import nested as N


def made(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        return {k: made(rng, depth - 1) for k in rng.sample(["id", "a", "page", "x y"], rng.randrange(4))}
    if depth and kind < 0.65:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([1, -2.5, "text", "", None, True, "é \" \\"])


def walk(value, path="$", name=None):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}", k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]", name)
    else:
        yield path, name, None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def test_leaves_at_any_depth(spark):
    rng = random.Random(5)
    docs = [(i, made(rng, 7)) for i in range(40)] + [(40, [[[[[[[{"id": [[{"id": 7}]]}]]]]]]]), (40, {"id": 1}), (41, {})]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in docs] + [(42, None)], "key long, text string").withColumn("value", F.parse_json("text"))
    got = sorted(((r.key, r.path, r.name, r.leaf) for r in N.leaves(rows, "key", "value").collect()), key=repr)
    assert got == sorted(((i, *x) for i, v in docs for x in walk(v)), key=repr)
    ids = N.named_values(rows, "key", "value", ["id"]).where("key = 40").collect()
    assert {(r.path, r.leaf) for r in ids} == {("$.id", "1"), ("$" + "[0]" * 7 + ".id[0][0].id", "7")}
    assert N.leaves(rows.limit(0), "key", "value").count() == 0


def test_private_names_and_values(spark):
    rows = spark.createDataFrame([(1, '{"a": {"gold_id": 3}, "b": ["The  Secret", "open"]}'), (2, '{"b": "open"}'), (3, '{"expected": [1, 2]}')], "key long, text string").withColumn("value", F.parse_json("text"))
    secrets = spark.createDataFrame([("the secret",), ("OPEN",), (None,), ("",)], "s string")
    found = N.leaves(rows, "key", "value")
    got = N.private_leaks(found, "key", secrets, "s", "^(gold_.*|expected)$", F.lower("leaf") == "open").collect()
    assert sorted(map(tuple, got)) == [(1, "$.a.gold_id", "key"), (1, "$.b[0]", "value"), (3, "$.expected[0]", "key"), (3, "$.expected[1]", "key")]


def test_many_levels_are_one_write(spark, monkeypatch):
    written, settle = [], N.settle
    monkeypatch.setattr(N, "settle", lambda df, name: written.append(name) or settle(df, name))
    rows = spark.createDataFrame([(1, '{"a": ' * 7 + '{"k": 1, "x": 2}' + "}" * 7), (2, '{"k": {}, "x": [[], {"k": null}]}')], "key long, text string").withColumn("value", F.parse_json("text"))
    got = N.named_values(rows, "key", "value", ["k"]).collect()
    assert sorted(map(tuple, got)) == [(1, "$" + ".a" * 7 + ".k", "1"), (2, "$.x[1].k", None)]
    assert len(written) == 2  # eight levels down to the values, and one more to see that they are plain
