"""Joins of the temporal model: spines, succession, novelty, evidence and resolution cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators import temporal as T


def anchor_spines(facts: DataFrame, cutoff: Column, until: Column) -> DataFrame:
    """Two-transition spines in three uses of the facts.

    A holder at the cutoff (s0) takes a later anchor (s1), and that anchor gets
    another holder (s2).  facts: anchor, holder, start, end.  Equi-joins on
    holder and anchor carry the date and inequality residuals.
    """
    live = facts.where((F.col("start") <= cutoff) & (F.col("end").isNull() | (F.col("end") >= cutoff)))
    s0 = live.select(F.col("anchor").alias("anchor_0"), F.col("holder").alias("person_0"), F.col("start").alias("start_0")).distinct()
    later = facts.where(T.in_window(F.col("start"), cutoff, until)).select("anchor", "holder", "start").distinct()
    s1 = later.select(F.col("anchor").alias("anchor_1"), F.col("holder").alias("person_0"), F.col("start").alias("start_1"))
    s2 = later.select(F.col("anchor").alias("anchor_1"), F.col("holder").alias("person_2"), F.col("start").alias("start_2"))
    two = s0.join(s1, "person_0").where("anchor_0 <> anchor_1")
    return two.join(s2, "anchor_1").where("start_2 > start_1 and person_2 <> person_0")


def novel_pairs(rows: DataFrame, facts: DataFrame, anchor: str, holder: str, before: str) -> DataFrame:
    """Rows whose (anchor, holder) has no tenure that starts before the given date."""
    known = facts.groupBy(F.col("anchor").alias("_a"), F.col("holder").alias("_h")).agg(F.min("start").alias("_first"))
    hit = (F.col(anchor) == F.col("_a")) & (F.col(holder) == F.col("_h")) & (F.col("_first") < F.col(before))
    return rows.join(known, hit, "left_anti")


def inverse_unique(facts: DataFrame, targets: DataFrame, after: Column, until: Column, limit: int | None = None) -> DataFrame:
    """For each (object, property) of targets the one subject of the earliest date in (after, until].

    With a limit, objects with that many rows or more are incomplete and give nothing.
    """
    rows = facts.where(T.in_window(F.col("start"), after, until)).join(targets, "object")
    if limit is not None:
        full = rows.groupBy("object").count().where(F.col("count") >= limit)
        rows = rows.join(full, "object", "left_anti")
    return T.first_unique(rows, ["object", "property"], "start", "subject")


def first_offset(events: DataFrame, versions: DataFrame, key: str, date: str, offsets: list[int], passes: Column, ts: str, tie: str) -> DataFrame:
    """The least offset in days at which the version of the key then in force passes a test."""
    probes = events.withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).withColumn("_at", T.end_of_day(F.date_add(date, F.col("offset"))))
    found = T.as_of(probes, versions, key, "_at", ts, tie).where(F.col("version").isNotNull() & passes)
    return found.groupBy(*events.columns).agg(F.min("offset").alias("offset"))


def resolve_cascade(rows: DataFrame, nodes: DataFrame, title: str, exact: str, group: str) -> DataFrame:
    """Node of each row: by (title, exact), else by (title, group), else by a title with one node; else null.

    nodes: node, title, exact, group.
    """
    one = nodes.groupBy(F.col("title").alias("_t1"), F.col("exact").alias("_e1")).agg(F.min("node").alias("_n1"))
    two = nodes.groupBy(F.col("title").alias("_t2"), F.col("group").alias("_g2")).agg(F.min("node").alias("_n2"))
    three = nodes.groupBy(F.col("title").alias("_t3")).agg(F.min("node").alias("_n3"), F.max("node").alias("_m3")).where("_n3 = _m3")
    out = rows.join(one, (F.col(title) == F.col("_t1")) & (F.col(exact) == F.col("_e1")), "left")
    out = out.join(two, (F.col(title) == F.col("_t2")) & (F.col(group) == F.col("_g2")), "left").join(three, F.col(title) == F.col("_t3"), "left")
    return out.select(*rows.columns, F.coalesce("_n1", "_n2", "_n3").alias("node"))


def version_pairs(versions: DataFrame, title: str, version: str, most: int) -> DataFrame:
    """Ordered pairs (a, b) of distinct versions of one title.

    The versions of a title with more than `most` are one row each, with a null
    b that stands for all others of the title: as many rows as versions, from
    which the pairs follow.
    """
    rows = versions.select(title, F.col(version).alias("a")).distinct()
    sizes = rows.groupBy(title).agg(F.count("*").alias("_n"))
    rows = rows.join(sizes, title)
    few = rows.where(F.col("_n") <= most).drop("_n")
    pairs = few.join(few.withColumnRenamed("a", "b"), title).where("a <> b")
    many = rows.where(F.col("_n") > most).drop("_n")
    return pairs.unionByName(many.withColumn("b", F.lit(None).cast(many.schema["a"].dataType)))


def stub_join(links: DataFrame, nodes: DataFrame, target: str, node: str, cap: int) -> DataFrame:
    """Links with `kind`: a known node, a stub (the first `cap` unknown targets by name), or external."""
    known = links.join(nodes.select(F.col(node).alias("_node")).distinct(), F.col(target) == F.col("_node"), "left")
    names = known.where("_node is null").select(target).distinct().orderBy(target).limit(cap).withColumn("_stub", F.lit(True))
    out = known.join(names, target, "left")
    return out.withColumn("kind", F.when(F.col("_node").isNotNull(), "node").when(F.col("_stub"), "stub").otherwise("external")).drop("_node", "_stub")


def score_cells(gates: DataFrame, judged: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Keys of either side with zero-filled counters."""
    both = gates.join(judged, keys, "full")
    return both.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in counters))


def lookahead_links(hops: DataFrame, links: DataFrame) -> DataFrame:
    """Shortcuts: hop i whose source links to the target of a later hop j.

    hops: case, hop, source, target; links: source, target.
    """
    a = hops.select("case", F.col("hop").alias("i"), "source")
    b = hops.select("case", F.col("hop").alias("j"), "target")
    return a.join(b, "case").where("j > i").join(links.select("source", "target").distinct(), ["source", "target"], "left_semi").select("case", "i", "j")


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
