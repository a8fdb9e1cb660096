"""Logical relations of the temporal model as views over the driver tables.

Each view has a DataFrame form and the DuckDB text of the same relation, which
the oracles use as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-qualified facts: subject, property, object, rank, start and end date (null: open)."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    tail = F.col("event_id") % 10
    return e.select(
        F.col("event_id").alias("fact_id"), F.col("user_id").alias("subject"), F.col("event_type").alias("property"),
        F.get_json_object("props", "$.k").cast("long").alias("object"),
        F.when(tail == 0, "preferred").when(tail == 7, "deprecated").otherwise("normal").alias("rank"),
        F.to_date("ts").alias("start"), F.to_date(F.lead("ts").over(w)).alias("end"),
    )


FACTS = """facts AS (
  SELECT event_id AS fact_id, user_id AS subject, event_type AS property, CAST(json_extract_string(props, '$.k') AS BIGINT) AS object,
    CASE event_id % 10 WHEN 0 THEN 'preferred' WHEN 7 THEN 'deprecated' ELSE 'normal' END AS rank, CAST(ts AS DATE) AS start,
    CAST(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS DATE) AS "end" FROM events)"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page revisions: page, revision_id, ts and size."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("revision_id"), F.col("o_orderdate").alias("ts"), F.floor("o_totalprice").alias("size"), F.col("o_orderstatus").alias("status"))


REVISIONS = "revisions AS (SELECT o_custkey AS page, o_orderkey AS revision_id, o_orderdate AS ts, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderstatus AS status FROM orders)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperlinks between page numbers, first occurrence of each pair, with their order on the source page."""
    l = table(spark, sf_dir, "lineitem")
    target = 1 + (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 200
    return l.select(F.col("l_suppkey").alias("source"), target.alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")).groupBy("source", "target").agg(F.min("pos").alias("pos"))


LINKS = "links AS (SELECT l_suppkey AS source, 1 + (l_partkey * 7 + l_linenumber) % 200 AS target, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1, 2)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot-tagged result log with explicit line numbers."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.select(
        F.col("event_id").alias("line_no"), F.element_at(F.array(*map(F.lit, ["ripple", "control", "pk", "gate"])), (F.col("event_id") % 4 + 1).cast("int")).alias("slot"),
        F.col("event_type").alias("model"), F.col("user_id").alias("case_id"), F.when(F.col("event_id") % 2 == 0, "conflict").otherwise("control").alias("arm"),
        F.when(k % 5 == 0, None).otherwise(k % 4).alias("distance"), F.row_number().over(w).cast("long").alias("occurrence"),
        F.element_at(F.array(*map(F.lit, ["stick_new", "stick_old", "correct", "other"])), (k % 4 + 1).cast("int")).alias("label"),
        (F.col("event_id") % 3).alias("repeat"), F.concat(F.lit("c"), (F.col("event_id") % 2).cast("string")).alias("contract_hash"), k.alias("k"), "ts", "value",
    )


LOG = """raw_log AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
log AS (
  SELECT event_id AS line_no, (['ripple', 'control', 'pk', 'gate'])[event_id % 4 + 1] AS slot, event_type AS model, user_id AS case_id,
    CASE WHEN event_id % 2 = 0 THEN 'conflict' ELSE 'control' END AS arm, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 4 END AS distance,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS occurrence,
    (['stick_new', 'stick_old', 'correct', 'other'])[k % 4 + 1] AS label, event_id % 3 AS repeat, 'c' || CAST(event_id % 2 AS VARCHAR) AS contract_hash, k, ts, value FROM raw_log)"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of the pages in document order: page_id, pos, target and text."""
    found = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "target")).withColumn("pos", F.col("pos").cast("long"))


ANCHORS = """anchors AS (SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos, targets[pos] AS target FROM (
  SELECT page_id, targets, unnest(range(1, len(targets) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS targets FROM pages)))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories: attempt, step, action and text."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("attempt"), F.col("turn").alias("step"), F.col("role").alias("action"), "text")


TURNS = "turns AS (SELECT conv_id AS attempt, turn AS step, role AS action, text FROM conversations)"


def oracle(*views: str, body: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body
