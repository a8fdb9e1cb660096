"""Graph and search operators over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataline.operators import graph as G
from strataline.operators import joins as J
from strataline.operators import ordering as O
from strataline.operators import temporal as T
from strataline.operators.resumable import resume_search
from strataline.operators.staging import settle, shared_folder
from strataline.sources import views as V
from strataline.sources.views import FACTS, LINKS, LOG, REVISIONS, TURNS, oracle

QUERIES: dict = {}
ORACLE_SQL: dict = {}
CAP3 = "cap AS (SELECT source, target, pos FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos, target) AS rn FROM links) WHERE rn <= 3)"


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def capped(s, d):
    return G.cap_links(V.links(s, d), "source", ["pos", "target"], 3)


def seed(s, *nodes):
    return s.createDataFrame([(n,) for n in nodes], "node long")


def bfs_sql(step, depth, start=1):
    return f"walk(node, distance) AS (SELECT CAST({start} AS BIGINT), CAST(0 AS BIGINT) UNION SELECT {step}, distance + 1 FROM walk JOIN cap ON {'cap.source' if step == 'target' else 'cap.target'} = node WHERE distance < {depth})"


def recursive(*parts, body):
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


_add("gr01_outgoing_bfs", lambda s, d: G.distances(capped(s, d), seed(s, 1), 4), recursive(LINKS, CAP3, bfs_sql("target", 4), body="SELECT node, min(distance) AS distance FROM walk GROUP BY 1"))
_add("gr02_reverse_bfs", lambda s, d: G.distances(capped(s, d).select(F.col("target").alias("source"), F.col("source").alias("target")), seed(s, 5), 3), recursive(LINKS, CAP3, bfs_sql("source", 3, 5), body="SELECT node, min(distance) AS distance FROM walk GROUP BY 1"))


def _states(s, d):
    links = capped(s, d).select((F.col("pos") % 2).alias("version"), "source", "target")
    return links, links.select(F.col("source").alias("page"), "version").unionByName(links.select(F.col("target").alias("page"), "version")).distinct()


def _arena(s, d):
    return G.arena(*_states(s, d), s.createDataFrame([(5, 0)], "page long, version long"), 3, 100_000)


ARENA = """st AS (SELECT DISTINCT page, version FROM (SELECT source AS page, pos % 2 AS version FROM cap UNION ALL SELECT target, pos % 2 FROM cap)),
edge AS (SELECT DISTINCT CAST(pos % 2 AS VARCHAR) || ':' || CAST(source AS VARCHAR) AS source, CAST(pos % 2 AS VARCHAR) || ':' || CAST(target AS VARCHAR) AS target FROM cap
  UNION SELECT CAST(a.version AS VARCHAR) || ':' || CAST(a.page AS VARCHAR), CAST(b.version AS VARCHAR) || ':' || CAST(b.page AS VARCHAR) FROM st a JOIN st b ON a.page = b.page AND a.version <> b.version),
walk(node, distance) AS (SELECT '0:5', CAST(0 AS BIGINT) UNION SELECT source, distance + 1 FROM walk JOIN edge ON target = node WHERE distance < 3),
arena AS (SELECT node, min(distance) AS distance FROM walk GROUP BY 1)"""
_add("gr03_temporal_arena", lambda s, d: _arena(s, d)[0].select("node", "distance"), recursive(LINKS, CAP3, ARENA, body="SELECT node, distance FROM arena"))
_add("gr04_walk_counts", lambda s, d: G.path_counts(capped(s, d), seed(s, 1), 3).select("node", F.col("walks").cast("long").alias("walks"), "length"),
     oracle(LINKS, CAP3, "w0 AS (SELECT CAST(1 AS BIGINT) AS node, CAST(1 AS BIGINT) AS walks)", *(f"w{k} AS (SELECT target AS node, CAST(sum(walks) AS BIGINT) AS walks FROM w{k - 1} JOIN cap ON source = node GROUP BY 1)" for k in (1, 2, 3)), body=" UNION ALL ".join(f"SELECT node, walks, CAST({k} AS BIGINT) AS length FROM w{k}" for k in range(4))))


def _back_edges(s, d):
    """Predecessors of page states: other versions of the page first, then the pages that link to it."""
    edges = G.state_edges(*_states(s, d))
    page = lambda c: F.substring_index(c, ":", -1)
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"), (page("source") != page("target")).cast("int").alias("kind"))


def gr04(s, d):
    """The search stopped after 3 and after 40 more nodes, then run to its end."""
    edges = settle(_back_edges(s, d), "edges")
    path = f"{shared_folder(s)}/search-{uuid.uuid4().hex}"
    for budget in (3, 40, 1_000_000):
        nodes, report = resume_search(edges, ["kind", "target"], ["0:5"], path, depth=4, branch_cap=6, max_nodes=150, budget=budget, name="arena")
    return nodes.withColumn("complete", F.lit(report["status"] == "complete"))


def _level(k):
    """New nodes of level k in the order of discovery."""
    known = " UNION ALL ".join(f"SELECT node FROM b{j}" for j in range(k))
    total = " + ".join(f"(SELECT count(*) FROM b{j})" for j in range(k))
    return f"""b{k} AS (SELECT node, CAST({total} + row_number() OVER (ORDER BY spot) - 1 AS BIGINT) AS ord, CAST({k} AS BIGINT) AS depth, parent
  FROM (SELECT p.target AS node, min((b.ord, p.rn)) AS spot, arg_min(b.node, (b.ord, p.rn)) AS parent FROM b{k - 1} b JOIN pred p ON p.source = b.node WHERE p.target NOT IN ({known}) GROUP BY 1)
  QUALIFY row_number() OVER (ORDER BY spot) <= 150 - ({total}))"""


_add("gr04_checkpointed_bfs", gr04, recursive(LINKS, CAP3, ARENA, "pred AS (SELECT * FROM (SELECT target AS source, source AS target, row_number() OVER (PARTITION BY target ORDER BY CAST(split_part(source, ':', 2) <> split_part(target, ':', 2) AS INTEGER), source) AS rn FROM edge) WHERE rn <= 6)",
     "b0 AS (SELECT '0:5' AS node, CAST(0 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS depth, CAST(NULL AS VARCHAR) AS parent)", *(_level(k) for k in (1, 2, 3, 4)), body=" UNION ALL ".join(f"SELECT node, ord, depth, parent, true AS complete FROM b{k}" for k in range(5))))
_add("gr05_entity_distance", lambda s, d: G.distances(capped(s, d), seed(s, 2), 3).where("distance = 3").select("node"), recursive(LINKS, CAP3, bfs_sql("target", 3, 2), body="SELECT node FROM walk GROUP BY 1 HAVING min(distance) = 3"))
_add("gr06_induced_edges", lambda s, d: _arena(s, d)[1].select("source", "target"), recursive(LINKS, CAP3, ARENA, body="SELECT source, target FROM edge WHERE source IN (SELECT node FROM arena) AND target IN (SELECT node FROM arena)"))


def routes(s, d):
    w = Window.partitionBy("attempt").orderBy("step")
    page = 1 + (F.col("attempt") * 3 + F.col("step")) % 100
    t = V.turns(s, d).withColumn("source", page)
    return t.withColumn("target", F.lead("source").over(w)).where("target is not null").select(F.col("attempt").alias("route"), "step", "source", "target")


ROUTES = "r AS (SELECT * FROM (SELECT conv_id AS route, turn AS step, 1 + (conv_id * 3 + turn) % 100 AS source, lead(1 + (conv_id * 3 + turn) % 100) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations) WHERE target IS NOT NULL)"
_add("gr07_route_validation", lambda s, d: G.broken_routes(routes(s, d), V.links(s, d)).select("route", "step"), oracle(LINKS, ROUTES, body="SELECT route, step FROM r WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.source = r.source AND l.target = r.target)"))
_add("gr08_arena_audit", lambda s, d: _arena(s, d)[0].agg(F.count("*").alias("states"), F.max("distance").alias("deepest"), F.sha2(F.array_join(F.array_sort(F.collect_list("node")), ","), 256).alias("manifest")),
     recursive(LINKS, CAP3, ARENA, body="SELECT count(*) AS states, max(distance) AS deepest, sha256(string_agg(node, ',' ORDER BY node)) AS manifest FROM arena"))


def _tree(s, d):
    """Arena around the pages 1 to 5, its induced edges, and its successors."""
    links, pages = _states(s, d)
    states, edges, _ = G.arena(links, pages, s.createDataFrame([(n, v) for n in range(1, 6) for v in (0, 1)], "page long, version long"), 4, 100_000)
    states = settle(states.where("distance is not null"), "states")
    return states, edges, G.shortest_next(states, edges, [])


WIDE = ARENA.replace("SELECT '0:5', CAST(0 AS BIGINT)", "SELECT CAST(v AS VARCHAR) || ':' || CAST(n AS VARCHAR), CAST(0 AS BIGINT) FROM range(1, 6) a(n), range(0, 2) b(v)").replace("distance < 3", "distance < 4")
TREE = """tree AS (SELECT a.node, a.distance, (SELECT min(e.target) FROM edge e JOIN arena b ON b.node = e.target WHERE e.source = a.node AND b.distance = a.distance - 1) AS next FROM arena a)"""
CHAIN = "chain(node, distance, spot, steps) AS (SELECT node, distance, node, [node] FROM tree UNION ALL SELECT c.node, c.distance, t.next, list_append(steps, t.next) FROM chain c JOIN tree t ON t.node = c.spot WHERE t.next IS NOT NULL)"
_add("gr03_shortest_next", lambda s, d: _tree(s, d)[2], recursive(LINKS, CAP3, WIDE, TREE, body="SELECT node, distance, next FROM tree"))


def gr08_chains(s, d):
    states, edges, tree = _tree(s, d)
    chains = G.shortest_chains(tree, 4)
    # one chain in five is broken on purpose: its second step is left out, or its end
    broken = chains.withColumn("chain", F.when((F.col("distance") > 1) & (F.crc32(F.col("node").cast("binary")) % 5 == 0), F.concat(F.slice("chain", 1, 1), F.slice("chain", 3, 9))).when(F.crc32(F.col("node").cast("binary")) % 5 == 1, F.slice("chain", 1, F.greatest(F.size("chain") - 1, F.lit(1)))).otherwise(F.col("chain")))
    kept = G.chain_errors(chains, edges, states)
    found = G.chain_errors(broken, edges, states).select("node", (F.size("errors") > 0).alias("told"), (F.size("chain") != F.col("distance") + 1).alias("broken"))
    return kept.join(found, "node").select("node", F.array_join("chain", ">").alias("chain"), F.array_join("errors", ",").alias("errors"), (F.col("told") == F.col("broken")).alias("told"))


_add("gr08_chain_audit", gr08_chains, recursive(LINKS, CAP3, WIDE, TREE, CHAIN, body="SELECT node, array_to_string(steps, '>') AS chain, '' AS errors, true AS told FROM chain WHERE len(steps) = distance + 1"))
_add("gr09_waypoints", lambda s, d: routes(s, d).select("route", "step", F.explode(F.filter(F.array(F.struct(F.lit("source").alias("kind"), F.col("source").alias("page")), F.struct(F.lit("target").alias("kind"), F.col("target").alias("page"))), lambda x: (x.kind == "target") | (F.col("step") % 2 == 0))).alias("w")).select("route", "step", "w.kind", "w.page"),
     oracle(ROUTES, body="SELECT route, step, 'source' AS kind, source AS page FROM r WHERE step % 2 = 0 UNION ALL SELECT route, step, 'target', target FROM r"))
_add("gr10_version_key", lambda s, d: V.revisions(s, d).select("revision_id", F.concat_ws(":", F.col("revision_id").cast("string"), F.lower(F.col("status"))).alias("key")), oracle(REVISIONS, body="SELECT revision_id, CAST(revision_id AS VARCHAR) || ':' || lower(status) AS key FROM revisions"))
_add("gr11_titles_by_distance", lambda s, d: G.distances(capped(s, d), seed(s, 1), 4).groupBy("distance").agg(F.array_join(F.array_sort(F.collect_list("node")).cast("array<string>"), ",").alias("nodes")),
     recursive(LINKS, CAP3, bfs_sql("target", 4), body="SELECT distance, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS nodes FROM (SELECT node, min(distance) AS distance FROM walk GROUP BY 1) GROUP BY 1"))


FAMILY = "CASE WHEN property IN ('view', 'click') THEN 'browse' WHEN property = 'error' THEN 'fault' ELSE 'trade' END"


def gr12(s, d):
    f = V.facts(s, d)
    rates = f.groupBy("property").agg(F.floor(F.count_if(F.col("rank") == "preferred") * 100 / F.count("*")).alias("rate")).withColumn("family", F.expr(FAMILY))
    facts = f.where("rank <> 'deprecated'").select(F.col("subject").alias("source"), "property", F.col("object").alias("target"), F.col("start").alias("at"))
    chains = G.discover_chains(facts, rates, V.links(s, d), "2024-01-05", 3, 40, 5, 2, 2, 300, "s")
    return chains.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.array_join("properties", ",").alias("properties"), "score")


def chains_sql(hops, width):
    key = "array_to_string(nodes, '>') || '|' || array_to_string(props, ',')"
    best = lambda q: f"SELECT *, {key} AS state FROM ({q}) WHERE EXISTS (SELECT 1 FROM links l WHERE l.source = nodes[-2] AND l.target = nodes[-1]) ORDER BY score DESC, sha256('s|' || {key}) LIMIT {width}"
    parts = [
        "f AS MATERIALIZED (SELECT subject AS source, property, object AS target, start AS since FROM facts WHERE rank <> 'deprecated')",
        f"rates AS MATERIALIZED (SELECT property, {FAMILY} AS family, count(*) FILTER (WHERE rank = 'preferred') * 100 // count(*) AS rate FROM facts GROUP BY 1)",
        "d1 AS (SELECT source, property, since, min(target) AS lo, max(target) AS hi FROM f WHERE since <= DATE '2024-01-05' GROUP BY 1, 2, 3)",
        "n1 AS (SELECT source, property, max(since) AS since, arg_max(lo, since) AS lo, arg_max(hi, since) AS hi FROM d1 GROUP BY 1, 2)",
        f"s1 AS MATERIALIZED ({best('SELECT [source, lo] AS nodes, [property] AS props, [family] AS seen, since, 300 + rate AS score FROM n1 JOIN rates USING (property) WHERE lo = hi AND lo <> source')})",
    ]
    for k in range(2, hops + 1):
        grown = f"SELECT list_append(nodes, t) AS nodes, list_append(props, property) AS props, CASE WHEN known THEN seen ELSE list_append(seen, family) END AS seen, day AS since, score + CASE WHEN known THEN 0 ELSE 300 END + rate AS score FROM c{k} WHERE rn <= 5 AND NOT list_contains(nodes, t) AND (SELECT count(*) FROM (SELECT unnest(props) AS x) WHERE x = property) < 2"
        parts += [
            f"d{k} AS (SELECT state, property, f.since, min(target) AS lo, max(target) AS hi FROM s{k - 1} s JOIN f ON source = nodes[-1] AND f.since > s.since GROUP BY 1, 2, 3)",
            f"n{k} AS (SELECT state, property, min(since) AS day, arg_min(lo, since) AS t, arg_min(hi, since) AS hi FROM d{k} GROUP BY 1, 2)",
            f"c{k} AS (SELECT *, list_contains(seen, family) AS known, row_number() OVER (PARTITION BY state ORDER BY list_contains(seen, family), day, property, t) AS rn FROM n{k} JOIN s{k - 1} USING (state) JOIN rates USING (property) WHERE t = hi)",
            f"s{k} AS MATERIALIZED ({best(grown)})",
        ]
    body = " UNION ALL ".join(f"SELECT array_to_string(nodes, '>') AS path, array_to_string(props, ',') AS properties, score FROM s{k} WHERE len(seen) >= 2" for k in range(2, hops + 1))
    return oracle(FACTS, LINKS, *parts, body=body)


_add("gr12_beam_discovery", gr12, chains_sql(3, 40))


def _search(s, d, width, per_state, budget, page_rows=None, keep_blocked=True):
    links = O.ranked(V.links(s, d), ["source"], ["pos", "target"], "place").withColumn("gain", F.col("pos") % 101 - 100)
    answers = V.facts(s, d).where("property = 'purchase' and rank = 'preferred' and object % 2 = 0").select(F.col("subject").alias("node")).distinct()
    out = G.search(seed(s, 1, 2, 3), links, answers, width, per_state, budget, "s", page_rows, -5, -10, keep_blocked)
    return out.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


def search_sql(width, per_state, budget, page_rows=None, keep_blocked=True, rounds=16):
    key = "array_to_string(nodes, '>') || '|' || CAST(shown AS VARCHAR)"

    def best(rows):
        one = f"SELECT *, row_number() OVER (PARTITION BY nodes[-1], shown, list_sort(nodes), status ORDER BY score DESC, sha256('s|' || {key})) AS n FROM {rows}"
        return f"SELECT nodes, shown, status, score, {key} AS state FROM ({one}) WHERE n = 1 ORDER BY score DESC, sha256('s|' || {key} || '|' || status) LIMIT {width}"

    parts = [
        "e AS MATERIALIZED (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY pos, target) AS place, pos % 101 - 100 AS gain FROM links)",
        "goal AS MATERIALIZED (SELECT DISTINCT subject AS node FROM facts WHERE property = 'purchase' AND rank = 'preferred' AND object % 2 = 0)",
        "p0 AS (SELECT [x] AS nodes, CAST(0 AS BIGINT) AS shown, 'open' AS status, CAST(0 AS BIGINT) AS score FROM (VALUES (CAST(1 AS BIGINT)), (2), (3)) v(x))",
        f"s0 AS MATERIALIZED ({best('p0')})",
        f"left0 AS MATERIALIZED (SELECT CAST({budget} AS BIGINT) AS left_over)",
    ]
    for k in range(1, rounds + 1):
        own = "nodes, shown, score, state"
        acts = f"SELECT {own}, 'follow:' || CAST(target AS VARCHAR) AS action, target, gain FROM o{k} JOIN e ON source = nodes[-1]{' WHERE place <= shown' if page_rows else ''}"
        if page_rows:
            acts += f" UNION ALL SELECT {own}, 'list', NULL, -5 FROM o{k} JOIN e ON source = nodes[-1] WHERE place = shown + 1"
        acts += f" UNION ALL SELECT {own}, 'submit', NULL, -10 FROM o{k} JOIN goal ON node = nodes[-1]"
        parts += [
            f"o{k} AS MATERIALIZED (SELECT * FROM s{k - 1} WHERE status = 'open' AND (SELECT left_over FROM left{k - 1}) > 0)",
            f"r{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY gain DESC, sha256('s|' || state || '|' || action)) AS r FROM ({acts})) WHERE r <= {per_state})",
            f"x{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, sha256('s|' || state), r) AS t FROM r{k}) WHERE t <= (SELECT left_over FROM left{k - 1}))",
            f"left{k} AS MATERIALIZED (SELECT left_over - (SELECT count(*) FROM x{k}) AS left_over FROM left{k - 1})",
            f"y{k} AS MATERIALIZED (SELECT * FROM x{k} WHERE target IS NULL OR NOT list_contains(nodes, target))",
            f"p{k} AS (SELECT nodes, shown, status, score FROM s{k - 1} WHERE status <> 'open' OR (SELECT left_over FROM left{k - 1}) <= 0"
            f" UNION ALL SELECT CASE WHEN target IS NULL THEN nodes ELSE list_append(nodes, target) END, CASE action WHEN 'list' THEN shown + {page_rows or 0} WHEN 'submit' THEN shown ELSE 0 END, CASE action WHEN 'submit' THEN 'submitted' ELSE 'open' END, score + gain FROM y{k}"
            f" UNION ALL SELECT nodes, shown, 'exhausted', score FROM o{k} WHERE state NOT IN (SELECT state FROM {'y' if keep_blocked else 'r'}{k}))",
            f"s{k} AS MATERIALIZED ({best(f'p{k}')})",
        ]
    body = f"SELECT array_to_string(nodes, '>') AS path, shown, status, score, row_number() OVER (ORDER BY status = 'submitted' DESC, score DESC, sha256('s|' || {key} || '|' || status)) = 1 AS final FROM s{rounds}"
    return oracle(FACTS, LINKS, *parts, body=body)


def gr13(s, d):
    tails = T.single_target(V.facts(s, d).where("rank = 'preferred'"), ["subject", "property"], "object")
    return routes(s, d).where("step = 1").join(tails, F.col("target") == F.col("subject")).where("object not in (source, target)").select("route", "property", F.concat_ws(">", F.col("source").cast("string"), F.col("target").cast("string"), F.col("object").cast("string")).alias("path"))


_add("gr13_tail_expansion", gr13, oracle(FACTS, ROUTES, "t AS (SELECT subject, property, min(object) AS object FROM facts WHERE rank = 'preferred' GROUP BY 1, 2 HAVING count(DISTINCT object) = 1)", body="SELECT route, property, concat_ws('>', CAST(source AS VARCHAR), CAST(target AS VARCHAR), CAST(object AS VARCHAR)) AS path FROM r JOIN t ON subject = target WHERE step = 1 AND object NOT IN (source, target)"))
_add("gr14_cycle_rejection", lambda s, d: V.turns(s, d).groupBy("attempt").agg(F.collect_list(F.lower("action")).alias("p")).select("attempt", G.is_simple(F.col("p")).alias("simple")), oracle(TURNS, body="SELECT attempt, count(*) = count(DISTINCT lower(action)) AS simple FROM turns GROUP BY 1"))


def gr15(s, d):
    hops = routes(s, d).select(F.col("route").alias("case"), F.col("step").alias("hop"), "source", "target")
    cut = J.lookahead_links(hops, V.links(s, d)).groupBy("case").agg(F.count("*").alias("n"), F.max(F.col("j") - F.col("i")).alias("widest"))
    return cut.select(F.col("case").alias("route"), F.when(F.col("widest") > 2, "answer_leakage").when(F.col("n") > 2, "alternative").otherwise("local").alias("disposition"))


_add("gr15_shortcut_audit", gr15, oracle(LINKS, ROUTES, body="SELECT route, CASE WHEN max(j - i) > 2 THEN 'answer_leakage' WHEN count(*) > 2 THEN 'alternative' ELSE 'local' END AS disposition FROM (SELECT a.route, a.step AS i, b.step AS j FROM r a JOIN r b ON a.route = b.route AND b.step > a.step WHERE EXISTS (SELECT 1 FROM links l WHERE l.source = a.source AND l.target = b.target)) GROUP BY 1"))


def gr16(s, d):
    a = V.anchors(s, d).groupBy("page_id", F.lower("target").alias("title")).agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    w = Window.partitionBy("page_id").orderBy("pos", "title")
    return a.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 6").select("page_id", "title", "n", "place")


_add("gr16_graph_export", gr16, oracle(V.ANCHORS, body="SELECT page_id, title, n, place FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos, title) AS place FROM (SELECT page_id, lower(target) AS title, count(*) AS n, min(pos) AS pos FROM anchors GROUP BY 1, 2)) WHERE place <= 6"))
_add("gr17_observed_edges", lambda s, d: V.links(s, d).select("source", "target", F.lit(True).alias("known")).join(routes(s, d).select("source", "target").distinct().withColumn("seen", F.lit(True)), ["source", "target"], "full").select("source", "target", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("seen", F.lit(False)).alias("observed")),
     oracle(LINKS, ROUTES, "o AS (SELECT DISTINCT source, target FROM r)", body="SELECT coalesce(l.source, o.source) AS source, coalesce(l.target, o.target) AS target, l.source IS NOT NULL AS known, o.source IS NOT NULL AS observed FROM links l FULL JOIN o ON l.source = o.source AND l.target = o.target"))


def gr18(s, d):
    g = V.log(s, d).where("slot = 'gate'").groupBy("case_id", "model").agg(F.bool_or(F.expr("label = 'correct' and to_date(ts) <= date '2024-01-10'")).alias("early"), F.bool_or(F.expr("label = 'other'")).alias("unclear"), F.bool_and(F.expr("label in ('correct', 'stick_new')")).alias("all_ok"))
    v = F.when(F.col("early"), "leakage").when(F.col("unclear"), "unknown").when(F.col("all_ok"), "valid_alternative").otherwise("answer_only")
    return g.select("case_id", "model", v.alias("verdict"))


_add("gr18_shortcut_verdict", gr18, oracle(LOG, body="SELECT case_id, model, CASE WHEN bool_or(label = 'correct' AND CAST(ts AS DATE) <= DATE '2024-01-10') THEN 'leakage' WHEN bool_or(label = 'other') THEN 'unknown' WHEN bool_and(label IN ('correct', 'stick_new')) THEN 'valid_alternative' ELSE 'answer_only' END AS verdict FROM log WHERE slot = 'gate' GROUP BY 1, 2"))

# search over the graph
_add("se01_legal_links", lambda s, d: O.ranked(V.links(s, d), ["source"], ["pos", "target"], "rn").select("source", "target", F.floor((F.col("rn") - 1) / 10).alias("page_no"), F.count("*").over(Window.partitionBy("source")).alias("total")),
     oracle(LINKS, body="SELECT source, target, (row_number() OVER (PARTITION BY source ORDER BY pos, target) - 1) // 10 AS page_no, count(*) OVER (PARTITION BY source) AS total FROM links"))
_add("se02_verified_actions", lambda s, d: routes(s, d).join(V.links(s, d).select("source", "target"), ["source", "target"], "left_semi").select("route", "step"), oracle(LINKS, ROUTES, body="SELECT route, step FROM r WHERE EXISTS (SELECT 1 FROM links l WHERE l.source = r.source AND l.target = r.target)"))
_add("se03_environment_manifest", lambda s, d: V.links(s, d).groupBy("source").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("target")).cast("array<string>"), ","), 256).alias("digest")),
     oracle(LINKS, body="SELECT source, count(*) AS n, sha256(string_agg(CAST(target AS VARCHAR), ',' ORDER BY target)) AS digest FROM links GROUP BY 1"))
_add("se04_beam_search", lambda s, d: _search(s, d, 10, 5, 120), search_sql(10, 5, 120))
_add("se05_wide_beam_search", lambda s, d: _search(s, d, 30, 4, 150, 10, False), search_sql(30, 4, 150, 10, False))


def se06(s, d):
    span = V.revisions(s, d).agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    probe = F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: T.end_of_day(F.date_add("a", F.floor(F.datediff("b", "a") * k / 4).cast("int")))))
    points = V.revisions(s, d).select("page").distinct().crossJoin(F.broadcast(span)).select("page", probe.alias("at"))
    return T.as_of(points, V.revisions(s, d), "page", "at", "ts", "revision_id").where("version is not null").select("page", "version.revision_id").distinct()


_add("se06_revision_options", se06, oracle(REVISIONS, "span AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM revisions)", "p AS (SELECT CAST(a + CAST(date_diff('day', a, b) * k // 4 AS INTEGER) AS TIMESTAMP) + INTERVAL '86399 seconds' AS t FROM span, range(5) r(k))",
     body="SELECT DISTINCT page, rid AS revision_id FROM (SELECT page, t, arg_max(revision_id, (ts, revision_id)) AS rid FROM revisions, p WHERE ts <= t GROUP BY 1, 2)"))


def se09(s, d):
    t = V.turns(s, d).select("attempt", "step", F.array_distinct(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
    b = t.select("attempt", (F.col("step") + 1).alias("step"), F.col("w").alias("prev"))
    return t.join(b, ["attempt", "step"]).select("attempt", "step", F.size(F.array_remove(F.array_intersect("w", "prev"), "")).cast("long").alias("overlap"))


_add("se09_progress_overlap", se09, oracle(TURNS, "w AS (SELECT DISTINCT attempt, step, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS x FROM turns)", body="SELECT a.attempt, a.step, (SELECT count(*) FROM w p JOIN w q ON q.x = p.x WHERE p.x <> '' AND p.attempt = a.attempt AND q.attempt = a.attempt AND p.step = a.step AND q.step = a.step - 1) AS overlap FROM turns a JOIN turns b ON a.attempt = b.attempt AND b.step = a.step - 1"))


def se12(s, d):
    start = routes(s, d).where("step = 1").select("route", F.array("source").alias("path"), F.col("target").alias("page"))
    nxt = capped(s, d).groupBy("source").agg(F.min_by("target", F.struct("pos", "target")).alias("to"))
    out = start.join(nxt, start.page == nxt.source, "left")
    return out.select("route", F.array_join(F.array_append(F.array_append("path", F.col("page")), F.coalesce("to", F.lit(-1))).cast("array<string>"), ">").alias("path"), F.col("to").isNull().alias("error"))


_add("se12_state_transition", se12, oracle(LINKS, CAP3, ROUTES, "n AS (SELECT source, arg_min(target, (pos, target)) AS t FROM cap GROUP BY 1)", body="SELECT route, concat_ws('>', CAST(r.source AS VARCHAR), CAST(target AS VARCHAR), CAST(coalesce(t, -1) AS VARCHAR)) AS path, t IS NULL AS error FROM r LEFT JOIN n ON n.source = target WHERE step = 1"))
_add("se13_action_funnel", lambda s, d: V.links(s, d).groupBy("source").agg(F.count("*").alias("legal"), F.count_if(F.col("pos") % 2 == 0).alias("retrieved"), F.least(F.count_if(F.col("pos") % 2 == 0), F.lit(30)).alias("compacted")),
     oracle(LINKS, body="SELECT source, count(*) AS legal, count(*) FILTER (WHERE pos % 2 = 0) AS retrieved, least(count(*) FILTER (WHERE pos % 2 = 0), 30) AS compacted FROM links GROUP BY 1"))
_add("se11_forced_states", lambda s, d: O.ranked(V.links(s, d).where("source in (1, 2, 3)"), ["source"], [F.desc(F.col("pos") % 101), "target"], "r").where("r <= 3").select("source", "target", F.col("r").cast("long").alias("r")),
     oracle(LINKS, body="SELECT source, target, r FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos % 101 DESC, target) AS r FROM links WHERE source IN (1, 2, 3)) WHERE r <= 3"))

# legacy drivers
_add("lg03_subgraph", lambda s, d: G.induced(capped(s, d), G.distances(capped(s, d), seed(s, 1), 2)).select("source", "target"), recursive(LINKS, CAP3, bfs_sql("target", 2), body="SELECT source, target FROM cap WHERE source IN (SELECT node FROM walk) AND target IN (SELECT node FROM walk)"))


def lg05(s, d):
    c = V.facts(s, d).where("property = 'view'").groupBy("subject").agg(F.min("start").alias("since"), F.count("*").alias("views"))
    return J.first_per(c.where("since <= date '2024-01-04' and views between 8 and 18").withColumn("bucket", F.col("subject") % 10), ["bucket"], [F.desc("views"), "subject"]).select("bucket", "subject", "views")


_add("lg05_pivot_selection", lg05, oracle(FACTS, "c AS (SELECT subject, min(start) AS since, count(*) AS views FROM facts WHERE property = 'view' GROUP BY 1)", body="SELECT bucket, subject, views FROM (SELECT subject % 10 AS bucket, subject, views, row_number() OVER (PARTITION BY subject % 10 ORDER BY views DESC, subject) AS rn FROM c WHERE since <= DATE '2024-01-04' AND views BETWEEN 8 AND 18) WHERE rn = 1"))
