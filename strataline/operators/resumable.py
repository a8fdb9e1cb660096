"""Breadth-first search that stops after a budget and goes on where it stopped.

The nodes stand in a table in the order of discovery, which is the order of
expansion, so one number says how far the search has come.  A run reads the
manifest, expands nodes in order, writes what it finds as a new part, and
replaces the manifest in one step; a part that no manifest names is not read,
so a run that dies has done nothing.  The parameters are locked.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.sources.log import read_document, replace_document

CHUNK = 10_000  # nodes expanded between two manifests
_MANIFEST = "parameters string, parts array<string>, nodes long, expanded long, cap_reached boolean"


def _load(spark: SparkSession, path: str, parameters: str) -> dict | None:
    found = read_document(spark, f"{path}/manifest", _MANIFEST)
    if found is None:
        return None
    state = found.first().asDict()
    if state["parameters"] != parameters:
        raise ValueError("the search at this path has other parameters")
    return state


def _save(spark: SparkSession, path: str, state: dict) -> None:
    replace_document(spark.createDataFrame([tuple(state[c.split()[0]] for c in _MANIFEST.split(", "))], _MANIFEST).coalesce(1), f"{path}/manifest")


def _nodes(spark: SparkSession, path: str, state: dict, kind: str) -> DataFrame:
    return spark.read.schema(f"node {kind}, ord long, depth long, parent {kind}").parquet(*(f"{path}/nodes/{p}" for p in state["parts"]))


def _write(nodes: DataFrame, path: str) -> str:
    part = uuid.uuid4().hex
    nodes.write.parquet(f"{path}/nodes/{part}")
    return part


def resume_search(edges: DataFrame, order: list[str], start: list, path: str, depth: int, branch_cap: int, max_nodes: int, budget: int, name: str = "") -> tuple[DataFrame, dict]:
    """Expands at most `budget` more nodes of the search at `path`: (nodes, report).

    edges: source, target and the columns of `order`, by which a node's first
    `branch_cap` edges are taken in turn.  A node belongs to the first that
    reaches it.  nodes: node, ord, depth, parent.  report: status (complete or
    incomplete), nodes, expanded, frontier, cap_reached, and lower_bound, the
    least distance that a node which has not been found can have (none, if the
    search is complete).  Nodes at `depth` are not expanded; past `max_nodes`
    none are added.  The outcome does not depend on the budgets.

    start, depth, caps, order and name (which should tell the graph) are locked;
    others at the same path are an error.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)["source"]
    locked = json.dumps({"start": start, "depth": depth, "branch_cap": branch_cap, "max_nodes": max_nodes, "order": order, "name": name}, sort_keys=True, default=str)
    locked = f"{hashlib.sha256(locked.encode()).hexdigest()} {locked}"
    state = _load(spark, path, locked)
    if state is None:
        first = list(dict.fromkeys(start))[:max_nodes]
        rows = spark.createDataFrame([(n, i, 0, None) for i, n in enumerate(first)], f"node {kind}, ord long, depth long, parent {kind}")
        state = {"parameters": locked, "parts": [_write(rows, path)], "nodes": len(first), "expanded": 0, "cap_reached": len(set(start)) > max_nodes}
        _save(spark, path, state)
    rank = F.row_number().over(Window.partitionBy("source").orderBy(*order, "target"))
    while budget and state["expanded"] < state["nodes"]:
        take = min(budget, CHUNK, state["nodes"] - state["expanded"])
        known = _nodes(spark, path, state, kind)
        chunk = known.where((F.col("ord") >= state["expanded"]) & (F.col("ord") < state["expanded"] + take) & (F.col("depth") < depth))
        own = edges.join(chunk.select(F.col("node").alias("source")), "source", "left_semi").withColumn("_rank", rank).where(F.col("_rank") <= branch_cap)
        met = own.join(chunk.select(F.col("node").alias("source"), "ord", "depth"), "source").groupBy(F.col("target").alias("node")).agg(F.min(F.struct("ord", "_rank", "depth", F.col("source").alias("parent"))).alias("at"))
        new = met.join(known.select("node"), "node", "left_anti")
        room = max_nodes - state["nodes"]
        # at most CHUNK * branch_cap rows, and no more than there is room for
        first = new.orderBy("at.ord", "at._rank").limit(room)
        placed = first.select("node", (F.row_number().over(Window.orderBy("at.ord", "at._rank")) - 1 + state["nodes"]).cast("long").alias("ord"), (F.col("at.depth") + 1).alias("depth"), "at.parent")
        part = _write(placed, path)
        added = spark.read.parquet(f"{path}/nodes/{part}").count()
        over = added == room and new.limit(room + 1).count() > room
        state = state | {"parts": [*state["parts"], part] if added else state["parts"], "nodes": state["nodes"] + added, "expanded": state["expanded"] + take, "cap_reached": state["cap_reached"] or over}
        _save(spark, path, state)
        budget -= take
    nodes = _nodes(spark, path, state, kind)
    open_ = state["nodes"] - state["expanded"]
    head = nodes.where(F.col("ord") == state["expanded"]).first() if open_ else None
    report = {"status": "incomplete" if open_ else "complete", "nodes": state["nodes"], "expanded": state["expanded"], "frontier": open_, "cap_reached": state["cap_reached"], "lower_bound": head.depth + 1 if head and head.depth < depth else None}
    return nodes, report
