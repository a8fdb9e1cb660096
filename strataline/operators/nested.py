"""Walks over nested values of unknown depth, level by level, on VARIANT columns.

Each level is one lateral explode of the objects and arrays that are left; the
loop ends when none are.  Every eight levels are one scan and are written, so
lineage stays short, and what is walked next is only what is still nested.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.operators.staging import settle


#: Levels that are walked between two writes.
LEVELS = 8


def leaves(rows: DataFrame, key: str, value: str, names: list[str] | None = None) -> DataFrame:
    """(key, path, name, leaf, kind): every plain value inside a VARIANT column, with where it stands.

    path: as $.a[0].b; name: the last object key on the path; leaf: the value as
    text, null for a null.  Null values, and empty objects and arrays, give no
    leaf.  Rows with equal keys are walked each.  names: only leaves of these names.
    """
    spark, out = rows.sparkSession, None
    level = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.lit("$").alias("_path"), F.lit(None).cast("string").alias("_name"), F.col(value).alias("_value"), F.lit(True).alias("_open"))
    while True:
        for _ in range(LEVELS):
            # what has nothing inside stays as it is, so that only small values are asked for their kind
            level = spark.sql(
                """SELECT n._key, CASE WHEN e.pos IS NULL THEN n._path WHEN e.key IS NULL THEN concat(n._path, '[', e.pos, ']') ELSE concat(n._path, '.', e.key) END AS _path,
                  coalesce(e.key, n._name) AS _name, CASE WHEN e.pos IS NULL THEN n._value ELSE e.value END AS _value, e.pos IS NOT NULL AS _open
                FROM {level} n, LATERAL variant_explode_outer(CASE WHEN n._open THEN n._value END) e""",
                level=level,
            )
        level = level.withColumn("_kind", F.when(~F.col("_open"), F.schema_of_variant("_value")))
        plain = ~F.col("_kind").startswith("OBJECT") & ~F.col("_kind").startswith("ARRAY")
        level = settle(level.where(F.col("_open") | (plain if names is None else plain & F.col("_name").isin(names))), "walk")
        found = level.where(~F.col("_open"))
        out = found if out is None else out.unionByName(found)
        level = level.where("_open").drop("_kind")
        if level.isEmpty():
            break
    return out.select(F.col("_key").alias(key), F.col("_path").alias("path"), F.col("_name").alias("name"), F.expr("try_variant_get(_value, '$', 'string')").alias("leaf"), F.lower("_kind").alias("kind"))


def named_values(rows: DataFrame, key: str, value: str, names: list[str]) -> DataFrame:
    """(key, path, leaf) of the plain values that stand under one of the names, at any depth, also as elements of arrays."""
    return leaves(rows, key, value, names).select(key, "path", "leaf")


def private_leaks(found: DataFrame, key: str, secrets: DataFrame, secret: str, key_pattern: str, public: Column | None = None) -> DataFrame:
    """(key, path, reason) of leaves that must not go out: under a private name, or equal to a secret but for case and white space.

    found: of leaves().  The names on a path are held against key_pattern; public:
    whether a value is public anyway.
    """
    re.compile(key_pattern)
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))
    names = found.where(F.exists(F.split(F.regexp_replace("path", "\\[\\d+\\]", ""), "\\."), lambda n: F.regexp_like(n, F.lit("(?i)" + key_pattern)))).select(key, "path", F.lit("key").alias("reason"))
    hidden = secrets.where(F.col(secret).isNotNull()).select(fold(F.col(secret)).alias("_fold")).where("_fold <> ''").distinct()
    values = found.where("leaf is not null").withColumn("_fold", fold(F.col("leaf"))).join(hidden, "_fold", "left_semi")
    values = values.where(~F.coalesce(public, F.lit(False))) if public is not None else values
    return names.unionByName(values.select(key, "path", F.lit("value").alias("reason")))
