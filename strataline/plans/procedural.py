"""Sequential operators over the driver tables; SQL has no form for most of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import graph as G
from strataline.operators import procedural as P
from strataline.operators.staging import settle
from strataline.sources import views as V

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def sc02(s, d):
    got = V.table(s, d, "pages").select("page_id", P.parse_page("html").alias("p"))
    return got.select("page_id", F.length("p.content").cast("long").alias("n_chars"), F.size("p.links").cast("long").alias("n_links"), F.sha2("p.content", 256).alias("content_hash"))


def sc26(s, d):
    edges = settle(G.cap_links(V.links(s, d), "source", ["pos", "target"], 3).select("source", "target"), "edges")
    found = s.createDataFrame([(x, x, 0) for x in (1, 2, 3)], "seed int, node long, distance long")
    level = found
    for k in (1, 2):  # all seeds go on together
        step = level.join(edges, level.node == edges.source).select("seed", F.col("target").alias("node")).distinct()
        level = settle(step.join(found, ["seed", "node"], "left_anti").withColumn("distance", F.lit(k).cast("long")))
        found = found.unionByName(level)
    return found.groupBy("seed", "distance").agg(F.count("*").alias("n"))


def st05(s, d):
    t = V.turns(s, d).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n")))
    b = t.select("attempt", (F.col("step") + 1).alias("step"), F.col("text").alias("before"))
    got = t.join(b, ["attempt", "step"]).select("attempt", "step", P.revision_diff("before", "text").alias("x"))
    return got.select("attempt", "step", *(F.size(f"x.{c}").cast("long").alias(c) for c in ("removed", "added", "stable")))


def _variants(s, d):
    return V.facts(s, d).select(F.col("fact_id").alias("id"), F.lit(0).alias("grp"), F.col("property").alias("family"), (F.col("object") % 20).alias("property"), F.col("subject").alias("source"), F.col("object").alias("views"), (F.col("object") * 1.0).alias("score"))




def _ant_edges(s, d):
    return V.links(s, d).select("source", "target", ((F.col("pos") % 100) / 100.0).alias("score"), ((F.col("target") % 7) / 7.0).alias("heuristic"))


def _pages(s, d):
    return V.links(s, d).select(F.col("source").alias("run")).distinct().withColumn("start", F.col("run"))


def se07(s, d):
    return P.ant_search(_ant_edges(s, d), _pages(s, d), "seed", ants=2, steps=3)


def lg02(s, d):
    return P.random_walks(V.links(s, d).select("source", "target"), _pages(s, d), "seed", 0.2, 6)


def st05_bags(s, d):
    t = V.turns(s, d)
    block = t.select("attempt", "step", F.explode(F.split(F.replace("text", F.lit(". "), F.lit(".\n\n")), "\n\n")).alias("block"))
    after = block.groupBy("attempt", "step", "block").agg(F.count("*").alias("y"))
    before = after.select("attempt", (F.col("step") + 1).alias("step"), "block", F.col("y").alias("x"))
    x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    both = before.join(after, ["attempt", "step", "block"], "full").join(t.select("attempt", "step"), ["attempt", "step"], "left_semi").where("step > 0")
    return both.groupBy("attempt", "step").agg(*(F.sum(F.greatest(v, F.lit(0))).cast("long").alias(n) for n, v in (("removed", x - y), ("added", y - x), ("stable", F.least(x, y)))))


def sc02_links(s, d):
    p = V.table(s, d, "pages")
    return p.select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), 1)).cast("long").alias("n_links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def se08(s, d):
    steps = V.log(s, d).select(F.col("case_id").alias("run"), F.col("line_no").alias("step"), (F.col("k") % 12).alias("edge"), F.when(F.col("label") == "correct", 1.0).when(F.col("label") == "other", -0.5).otherwise(0.2).alias("reward"))
    return P.replay_pheromones(steps)


QUERIES.update(
    sc02_rendered_page=sc02, sc26_snapshot_build=sc26, st05_revision_diff=st05,
    sc02_page_links=sc02_links, st05_block_bags=st05_bags,
    so04_popularity_sampler=lambda s, d: P.greedy_pick(P.greedy_pool(_variants(s, d), 40, 2, ["views", "id"]), 40, {"family": 12, "property": 4, "source": 2}, P.by_popularity),
    so05_coverage_sampler=lambda s, d: P.greedy_pick(P.greedy_pool(_variants(s, d), 40, 2, ["score", "id"]), 40, {"source": 2, "family": 12, "property": 4}, P.by_coverage),
    so06_capped_round_robin=lambda s, d: P.capped_round_robin(P.greedy_pool(_variants(s, d).withColumn("_place", -F.col("id")), 40, 1, ["_place"]).drop("_place"), 40, "family", {"source": 1, "property": 3}),
    se07_ant_search=se07, se08_pheromone_replay=se08, lg02_random_walk=lg02,
)
ORACLE_SQL["sc26_snapshot_build"] = V.oracle(
    V.LINKS, "cap AS (SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos, target) AS rn FROM links) WHERE rn <= 3)",
    "w0 AS (SELECT CAST(x AS BIGINT) AS seed, CAST(x AS BIGINT) AS node FROM (VALUES (1), (2), (3)) v(x))", "w1 AS (SELECT seed, target AS node FROM w0 JOIN cap ON source = node)", "w2 AS (SELECT seed, target AS node FROM w1 JOIN cap ON source = node)",
    body="SELECT distance, count(*) AS n, CAST(seed AS INTEGER) AS seed FROM (SELECT seed, node, min(d) AS distance FROM (SELECT *, CAST(0 AS BIGINT) AS d FROM w0 UNION ALL SELECT *, 1 FROM w1 UNION ALL SELECT *, 2 FROM w2) GROUP BY 1, 2) GROUP BY seed, distance")

ORACLE_SQL["sc02_page_links"] = "SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS BIGINT) AS n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages"
ORACLE_SQL["st05_block_bags"] = V.oracle(
    V.TURNS, "b AS (SELECT attempt, step, block, count(*) AS y FROM (SELECT attempt, step, unnest(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10))) AS block FROM turns) GROUP BY 1, 2, 3)",
    "f AS (SELECT coalesce(p.attempt, n.attempt) AS attempt, coalesce(p.step, n.step) AS step, coalesce(p.y, 0) AS x, coalesce(n.y, 0) AS y FROM (SELECT attempt, step + 1 AS step, block, y FROM b) p FULL JOIN b n ON p.attempt = n.attempt AND p.step = n.step AND p.block = n.block)",
    body="SELECT attempt, step, CAST(sum(greatest(x - y, 0)) AS BIGINT) AS removed, CAST(sum(greatest(y - x, 0)) AS BIGINT) AS added, CAST(sum(least(x, y)) AS BIGINT) AS stable FROM f WHERE step > 0 AND (attempt, step) IN (SELECT attempt, step FROM turns) GROUP BY 1, 2")
_HASH = "sha256('seed|' || CAST(run AS VARCHAR) || '|' || CAST(k AS VARCHAR) || '|' || {})"
ORACLE_SQL["lg02_random_walk"] = "WITH RECURSIVE " + V.LINKS + f""",
walk AS (
  SELECT source AS run, 0 AS k, source AS node, CAST(source AS VARCHAR) AS path FROM (SELECT DISTINCT source FROM links)
  UNION ALL
  SELECT run, k + 1, to_, path || '>' || CAST(to_ AS VARCHAR) FROM (
    SELECT run, k, path, arg_min(target, {_HASH.format("CAST(target AS VARCHAR)")}) AS to_ FROM walk JOIN links ON links.source = walk.node
    WHERE k < 5 AND substring({_HASH.format("'stop'")}, 1, 8) >= '33333333' GROUP BY run, k, path))
SELECT run, CAST(max(k) + 1 AS BIGINT) AS steps, arg_max(path, k) AS path FROM walk GROUP BY run"""
