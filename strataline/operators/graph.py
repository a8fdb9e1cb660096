"""Graph operators: frontiers, arenas, routes and beam discovery.

A frontier moves one level at a time; each level is a join, an anti-join with
what was seen, and a written table, so lineage stays short and a lost executor
costs one level.  Depth and caps are explicit, and truncation is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.staging import settle


def cap_links(links: DataFrame, source: str, order: list[str], cap: int) -> DataFrame:
    """The first `cap` links of each page: applied before any test of what was seen."""
    w = Window.partitionBy(source).orderBy(*order)
    return links.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def distances(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, distance) within `depth` steps.  edges: source, target; seeds: node.

    The edges are written once, so that no level computes them anew.
    """
    edges = settle(edges.select("source", "target"), "edges")
    found = settle(seeds.select("node").distinct().withColumn("distance", F.lit(0).cast("long")))
    frontier = found
    for level in range(1, depth + 1):
        step = frontier.join(edges, frontier.node == edges.source).select(F.col("target").alias("node")).distinct()
        frontier = settle(step.join(found.select("node"), "node", "left_anti").withColumn("distance", F.lit(level).cast("long")))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def path_counts(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Number of walks of each length from the seeds to each node."""
    level = seeds.select("node").distinct().withColumn("walks", F.lit(1).cast("decimal(38,0)"))
    out = level.withColumn("length", F.lit(0).cast("long"))
    for k in range(1, depth + 1):
        level = settle(level.join(edges, level.node == edges.source).groupBy(F.col("target").alias("node")).agg(F.sum("walks").cast("decimal(38,0)").alias("walks")))
        out = out.unionByName(level.withColumn("length", F.lit(k).cast("long")))
    return out


def state_key(page: Column, version: Column) -> Column:
    return F.concat_ws(":", version.cast("string"), page.cast("string"))


def state_edges(links: DataFrame, versions: DataFrame) -> DataFrame:
    """Steps between page states: links within a version, and changes of version on a page."""
    hyper = links.select(state_key(F.col("source"), F.col("version")).alias("source"), state_key(F.col("target"), F.col("version")).alias("target"))
    v = versions.select("page", state_key(F.col("page"), F.col("version")).alias("k"))
    switch = v.select("page", F.col("k").alias("source")).join(v.select("page", F.col("k").alias("target")), "page").where("source <> target").select("source", "target")
    return hyper.unionByName(switch).distinct()


def arena(links: DataFrame, versions: DataFrame, target: DataFrame, depth: int, node_cap: int, forced: DataFrame | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Backward arena over (page, version) states: (states with distance, edges, truncated).

    links: version, source, target (pages).  versions: page, version.  target:
    page, version.  A state's predecessors are the pages that link to it in its
    version, and the other versions of its page.  Nodes are taken by level, then
    by key, up to `node_cap`; forced states always belong.  Distances are
    recomputed on the edges between the kept states.
    """
    key = state_key
    edges = settle(state_edges(links, versions), "arena")
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    seeds = target.select(key(F.col("page"), F.col("version")).alias("node"))
    reached = settle(distances(back, seeds, depth))
    truncated = reached.count() > node_cap
    kept = reached.orderBy("distance", "node").limit(node_cap).select("node")
    if forced is not None:
        kept = kept.unionByName(forced.select(key(F.col("page"), F.col("version")).alias("node"))).distinct()
    kept = settle(kept)
    inside = induced(edges, kept)
    exact = distances(inside.select(F.col("target").alias("source"), F.col("source").alias("target")), seeds, depth * 2)
    return kept.join(exact, "node", "left"), inside, truncated


def shortest_next(states: DataFrame, edges: DataFrame, order: list[str]) -> DataFrame:
    """(node, distance, next): for each node the first by `order` of the nodes one step nearer that it leads to; null at distance 0.

    states: node, distance.  edges: source, target and the columns of `order`,
    which may be of the target (then `target` itself is the last of them).  The
    successors form a tree of shortest paths.
    """
    steps = edges.join(states.select(F.col("node").alias("source"), F.col("distance").alias("_from")), "source").join(states.select(F.col("node").alias("target"), F.col("distance").alias("_to")), "target").where("_from = _to + 1")
    first = steps.groupBy("source").agg(F.min_by("target", F.struct(*dict.fromkeys([*order, "target"]))).alias("next"))
    return states.join(first, states.node == first.source, "left").select("node", "distance", "next")


def shortest_chains(tree: DataFrame, depth: int) -> DataFrame:
    """(node, distance, chain): the way of each node through its successors, up to `depth` steps.

    The tree is written once; each step is one join, and only nodes that are not
    at their end go on.
    """
    tree = settle(tree, "tree")
    open_ = tree.select("node", "distance", F.array("node").alias("chain"), F.col("next").alias("_at"))
    done = open_.where("_at is null")
    for _ in range(depth):
        ahead = tree.select(F.col("node").alias("_at"), F.col("next").alias("_next"))
        open_ = settle(open_.where("_at is not null").join(ahead, "_at").select("node", "distance", F.concat("chain", F.array("_at")).alias("chain"), F.col("_next").alias("_at")), "chains")
        done = done.unionByName(open_.where("_at is null"))
    return done.unionByName(open_.where("_at is not null")).select("node", "distance", "chain")


def chain_errors(chains: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """chains with errors: their length is not the distance, a step is no edge, a step does not come one nearer, or the end is not at 0.

    chains: node, distance, chain.  Steps are held against the edges and the
    distances by joins on the step's two ends.
    """
    steps = chains.select("node", F.posexplode(F.arrays_zip(F.slice("chain", 1, F.size("chain") - 1).alias("source"), F.slice("chain", 2, F.size("chain")).alias("target"))).alias("_k", "_s")).select("node", "_k", "_s.source", "_s.target")
    known = edges.select("source", "target").distinct().withColumn("_edge", F.lit(True))
    ends = states.select("node", "distance")
    checked = steps.join(known, ["source", "target"], "left").join(ends.select(F.col("node").alias("source"), F.col("distance").alias("_a")), "source", "left").join(ends.select(F.col("node").alias("target"), F.col("distance").alias("_b")), "target", "left")
    bad = checked.groupBy("node").agg(F.coalesce(F.bool_or(F.col("_edge").isNull()), F.lit(False)).alias("_no_edge"), F.coalesce(F.bool_or(~F.col("_a").eqNullSafe(F.col("_b") + 1)), F.lit(False)).alias("_not_nearer"))
    last = chains.select("node", F.element_at("chain", -1).alias("_last")).join(ends.where("distance = 0").select(F.col("node").alias("_last"), F.lit(True).alias("_home")), "_last", "left").select("node", "_home")
    told = F.array_compact(F.array(
        F.when(F.size("chain") - 1 != F.col("distance"), F.lit("length")), F.when(F.col("_no_edge"), F.lit("edge")), F.when(F.col("_not_nearer"), F.lit("distance")), F.when(F.col("_home").isNull(), F.lit("end")),
    ))
    return chains.join(bad, "node", "left").join(last, "node").select("node", "distance", "chain", told.alias("errors"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    a, b = nodes.select(F.col("node").alias("source")), nodes.select(F.col("node").alias("target"))
    return edges.join(a, "source", "left_semi").join(b, "target", "left_semi")


def broken_routes(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps of routes that are no edge.  routes: route, step, source, target."""
    return routes.join(edges.select("source", "target").distinct(), ["source", "target"], "left_anti")


def is_simple(path: Column) -> Column:
    """A path without a repeated value."""
    return F.size(F.array_distinct(path)) == F.size(path)


def _text(values: str, by: str = ">") -> Column:
    return F.array_join(F.col(values).cast("array<string>"), by)


def single_dated(rows: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """The target of the first (or last) date of each key; keys with several targets on that date give nothing.

    rows: keys, at, target.  Two aggregates with map-side combine, so a hot key
    costs a row per date and task.
    """
    days = rows.groupBy(*keys, "at").agg(F.min("target").alias("lo"), F.max("target").alias("hi"))
    pick = F.max if last else F.min
    return days.groupBy(*keys).agg(pick(F.struct("at", "lo", "hi")).alias("d")).where("d.lo = d.hi").select(*keys, "d.at", F.col("d.lo").alias("target"))


def discover_chains(facts: DataFrame, rates: DataFrame, support: DataFrame, cutoff: str, hops: int, width: int, per_state: int, per_property: int, families: int, novelty: int, seed: str) -> DataFrame:
    """Chains of facts, each the next of its property after the one before: (path, properties, score).

    facts: source, property, target, at.  rates: property, family, rate.
    support: source, target of the edges that count as verified.  A chain begins
    with the last single fact of a page and property until `cutoff`.  An
    expansion takes the next single fact of each property, the first `per_state`
    by new family, date, property and target; a property may occur
    `per_property` times, a page once, and the edge must be verified.  A new
    family scores `novelty`, each hop the rate of its property.  The best
    `width` chains go on, so a broadcast frontier is bounded by that parameter;
    chains of two hops or more and at least `families` families are returned.
    """
    verified = support.select("source", "target").distinct()
    key = F.concat_ws("|", _text("path"), _text("properties", ","))
    tie = F.sha2(F.concat(F.lit(f"{seed}|"), key), 256)

    def best(rows: DataFrame) -> DataFrame:
        rows = rows.join(verified, ["source", "target"], "left_semi").select("path", "properties", "seen", "at", "score")
        return settle(rows.orderBy(F.desc("score"), tie).limit(width).withColumn("state", key), "chains")

    first = single_dated(facts.where(F.col("at") <= F.lit(cutoff).cast("date")), ["source", "property"], True).where("source <> target").join(rates, "property")
    states = best(first.select("source", "target", F.array("source", "target").alias("path"), F.array("property").alias("properties"), F.array("family").alias("seen"), "at", (novelty + F.col("rate")).alias("score")))
    done = []
    for _ in range(hops - 1):
        ends = states.select("state", F.element_at("path", -1).alias("source"), F.col("at").alias("since"))
        later = facts.join(F.broadcast(ends), "source").where(F.col("at") > F.col("since"))
        found = single_dated(later, ["state", "source", "property"], False).join(rates, "property").withColumnRenamed("at", "day").join(F.broadcast(states), "state")
        fresh = ~F.array_contains("seen", F.col("family"))
        order = Window.partitionBy("state").orderBy(~fresh, "day", "property", "target")
        found = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_state)
        found = found.where((F.size(F.filter("properties", lambda x: x == F.col("property"))) < per_property) & ~F.array_contains("path", F.col("target")))
        states = best(found.select(
            "source", "target", F.array_append("path", F.col("target")).alias("path"), F.array_append("properties", F.col("property")).alias("properties"),
            F.array_union("seen", F.array("family")).alias("seen"), F.col("day").alias("at"), (F.col("score") + F.when(fresh, novelty).otherwise(0) + F.col("rate")).alias("score"),
        ))
        done.append(states.where(F.size("seen") >= families).select("path", "properties", "score"))
        if states.isEmpty():
            break
    out = done[0] if done else states.where("false").select("path", "properties", "score")
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def search(start: DataFrame, links: DataFrame, answers: DataFrame, width: int, per_state: int, budget: int, seed: str, page_rows: int | None = None, list_gain: int = 0, submit_gain: int = 0, keep_blocked: bool = True) -> DataFrame:
    """Beam search with terminal states: (path, shown, status, score, final) of the retained states.

    start: node.  links: source, target, place (1, 2, ... on its page), gain.
    answers: node, the pages on which a submission passes its gate.  Actions of
    an open state are to follow a link, to submit, and, with `page_rows`, to
    list that many more links: then only listed links can be followed.  The best
    `per_state` actions of a state are executed, states in order, until `budget`
    actions are spent in all; moves to a page of the path are spent too, and
    dropped.  A state without a kept child (with keep_blocked) or without any
    action (without) stays as exhausted.  Submitted and exhausted states compete
    with the others.  States with one page, listing, set of pages and status
    count as one; the best `width` go on, so a broadcast frontier is bounded by
    that parameter.  `final` marks the best submitted state, or the best at all.
    """
    key = F.concat_ws("|", _text("path"), F.col("shown").cast("string"))
    digest = lambda *parts: F.sha2(F.concat_ws("|", F.lit(seed), *parts), 256)
    links = settle(links.select("source", "target", "place", "gain"), "links")
    goals = answers.select(F.col("node").alias("page")).distinct()

    def best(rows: DataFrame) -> DataFrame:
        same = Window.partitionBy(F.element_at("path", -1), "shown", F.array_sort("path"), "status").orderBy(F.desc("score"), digest(key))
        rows = rows.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
        rows = rows.orderBy(F.desc("score"), digest(key, F.col("status"))).limit(width)
        return settle(rows.withColumn("state", key).withColumn("page", F.element_at("path", -1)), "search")

    names = ["path", "shown", "status", "score"]
    zero = F.lit(0).cast("long")
    states = best(start.select(F.array("node").alias("path"), zero.alias("shown"), F.lit("open").alias("status"), zero.alias("score")))
    while budget > 0 and not (live := states.where("status = 'open'")).isEmpty():
        near = links.join(F.broadcast(live), F.col("source") == F.col("page"))
        legal = near if page_rows is None else near.where("place <= shown")
        own = ["state", *names]
        actions = legal.select(*own, F.concat(F.lit("follow:"), F.col("target").cast("string")).alias("action"), "target", F.col("gain").cast("long").alias("gain"))
        none = F.lit(None).cast("long").alias("target")
        if page_rows is not None:
            actions = actions.unionByName(near.where("place = shown + 1").select(*own, F.lit("list").alias("action"), none, F.lit(list_gain).cast("long").alias("gain")))
        actions = actions.unionByName(live.join(goals, "page").select(*own, F.lit("submit").alias("action"), none, F.lit(submit_gain).cast("long").alias("gain")))
        ranked = Window.partitionBy("state").orderBy(F.desc("gain"), digest(F.col("state"), F.col("action")))
        turn = Window.orderBy(F.desc("score"), digest(F.col("state")), "_r")
        chosen = actions.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= per_state)
        spent = settle(chosen.withColumn("_t", F.row_number().over(turn)).where(F.col("_t") <= budget), "spent")
        kept = spent.where(F.col("target").isNull() | ~F.array_contains("path", F.col("target")))
        left = live.join((kept if keep_blocked else chosen).select("state").distinct(), "state", "left_anti")
        moved = kept.select(
            F.when(F.col("target").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("target"))).alias("path"),
            F.when(F.col("action") == "list", F.col("shown") + (page_rows or 0)).when(F.col("action") == "submit", F.col("shown")).otherwise(zero).alias("shown"),
            F.when(F.col("action") == "submit", "submitted").otherwise("open").alias("status"), (F.col("score") + F.col("gain")).alias("score"),
        )
        blocked = left.select("path", "shown", F.lit("exhausted").alias("status"), "score")
        states = best(states.where("status <> 'open'").select(*names).unionByName(moved).unionByName(blocked))
        budget -= spent.count()
    first = Window.orderBy(F.desc(F.col("status") == "submitted"), F.desc("score"), digest(key, F.col("status")))
    return states.select(*names, (F.row_number().over(first) == 1).alias("final"))
