"""Joins over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataline.operators import joins as J
from strataline.operators import temporal as T
from strataline.sources import views as V
from strataline.sources.views import ANCHORS, FACTS, LINKS, LOG, REVISIONS, TURNS, oracle

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _cutoff():
    return F.lit("2024-01-10").cast("date")


def _until():
    return F.lit("2024-01-12").cast("date")


#: Tenures: anchors are the objects of purchases, holders their subjects.
TENURES = """t AS (SELECT object AS anchor, subject AS holder, start, "end" FROM facts WHERE property = 'purchase')"""
SPINES = """later AS (SELECT DISTINCT anchor, holder, start FROM t WHERE start > DATE '2024-01-10' AND start <= DATE '2024-01-12'),
s0 AS (SELECT DISTINCT anchor AS anchor_0, holder AS person_0, start AS start_0 FROM t WHERE start <= DATE '2024-01-10' AND ("end" IS NULL OR "end" >= DATE '2024-01-10')),
spine AS (SELECT anchor_1, person_0, anchor_0, start_0, s1.start AS start_1, s2.holder AS person_2, s2.start AS start_2 FROM s0 JOIN (SELECT anchor AS anchor_1, holder, start FROM later) s1 ON s1.holder = person_0 AND anchor_1 <> anchor_0 JOIN later s2 ON s2.anchor = anchor_1 AND s2.start > s1.start AND s2.holder <> person_0)"""


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def tenures(s, d):
    return V.facts(s, d).where("property = 'purchase'").select(F.col("object").alias("anchor"), F.col("subject").alias("holder"), "start", "end")


def spines(s, d):
    return J.anchor_spines(tenures(s, d), _cutoff(), _until())


_add("jn01_cutoff_anchor_spine", spines, oracle(FACTS, TENURES, SPINES, body="SELECT * FROM spine"))


def jn02(s, d):
    t = tenures(s, d)
    wanted = V.facts(s, d).where("property = 'error' and start = date '2024-01-11'").select(F.col("object").alias("anchor")).distinct()
    return J.anchor_spines(t.join(wanted, "anchor", "left_semi"), _cutoff(), _until())


_add("jn02_event_first_spine", jn02, oracle(FACTS, "t0 AS (SELECT object AS anchor, subject AS holder, start, \"end\" FROM facts WHERE property = 'purchase')", "t AS (SELECT * FROM t0 WHERE anchor IN (SELECT object FROM facts WHERE property = 'error' AND start = DATE '2024-01-11'))", SPINES, body="SELECT * FROM spine"))
_add("jn03_pair_novelty", lambda s, d: J.novel_pairs(J.novel_pairs(spines(s, d), tenures(s, d), "anchor_1", "person_0", "start_1"), tenures(s, d), "anchor_1", "person_2", "start_2"),
     oracle(FACTS, TENURES, SPINES, body="SELECT * FROM spine p WHERE NOT EXISTS (SELECT 1 FROM t WHERE anchor = anchor_1 AND holder = person_0 AND start < start_1) AND NOT EXISTS (SELECT 1 FROM t WHERE anchor = anchor_1 AND holder = person_2 AND start < start_2)"))


def jn04(s, d):
    targets = V.table(s, d, "part").where("p_size = 1").select((F.col("p_partkey") % 100).alias("object")).distinct()
    return V.facts(s, d).join(targets, "object").where(T.holds_at(F.col("start"), F.col("end"), _cutoff())).select("subject", "object", "property").distinct()


_add("jn04_inverse_anchor", jn04, oracle(FACTS, body="""SELECT DISTINCT subject, object, property FROM facts WHERE object IN (SELECT p_partkey % 100 FROM part WHERE p_size = 1) AND (start IS NULL OR start <= DATE '2024-01-10') AND ("end" IS NULL OR "end" >= DATE '2024-01-10')"""))


def jn05(s, d):
    f = V.facts(s, d)
    return J.inverse_unique(f, f.where("property = 'signup'").select("object").distinct(), _cutoff(), F.lit("2024-01-20").cast("date"), 40)


_add("jn05_inverse_transition", jn05, oracle(FACTS, "r AS (SELECT * FROM facts WHERE start > DATE '2024-01-10' AND start <= DATE '2024-01-20' AND object IN (SELECT object FROM facts WHERE property = 'signup'))",
     "q AS (SELECT * FROM r WHERE object NOT IN (SELECT object FROM r GROUP BY 1 HAVING count(*) >= 40))", body="SELECT object, property, start, min(subject) AS subject FROM (SELECT *, min(start) OVER (PARTITION BY object, property) AS m FROM q) WHERE start = m GROUP BY 1, 2, 3 HAVING count(DISTINCT subject) = 1"))


#: Parts into which the movers of a holder are dealt, so that a common holder's pairs spread over as many tasks.
JN06_PARTS = 16


def jn06(s, d):
    """Movers and anchors of one holder; both sides are distinct, so their pairs are, and none is shuffled or compared again."""
    moves = T.successor_transitions(V.facts(s, d).where("property = 'purchase'"), "subject", "object", ["start", "fact_id"]).where("start > date '2024-01-10'")
    moves = moves.select("subject", "to_holder", "start").distinct().withColumn("part", F.pmod(F.xxhash64("subject"), F.lit(JN06_PARTS)).cast("int"))
    held = V.facts(s, d).where("property = 'view'").where(T.holds_at(F.col("start"), F.col("end"), _cutoff())).select(F.col("object").alias("to_holder"), F.col("subject").alias("anchor")).distinct()
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(JN06_PARTS - 1))))
    return moves.join(held, ["to_holder", "part"]).where("anchor <> subject").select("subject", "to_holder", "anchor", "start")


_add("jn06_anchor_hash_join", jn06, oracle(FACTS, "m AS (SELECT subject, lag(object) OVER w AS f, object AS to_holder, start FROM facts WHERE property = 'purchase' WINDOW w AS (PARTITION BY subject ORDER BY start, fact_id))",
     """h AS (SELECT object, subject AS anchor FROM facts WHERE property = 'view' AND start <= DATE '2024-01-10' AND ("end" IS NULL OR "end" >= DATE '2024-01-10'))""", body="SELECT DISTINCT subject, to_holder, anchor, start FROM m JOIN h ON object = to_holder WHERE f <> to_holder AND start > DATE '2024-01-10' AND anchor <> subject"))  # fmt: skip


def jn07(s, d):
    f = V.facts(s, d)
    first = T.first_unique(f.where(T.in_window(F.col("start"), _cutoff(), F.lit("2024-01-25").cast("date")) & (F.col("property") == "click")), ["subject"], "start", "object")
    nxt = f.where("property = 'click'").select(F.col("object"), F.col("subject").alias("successor"), F.col("start").alias("next_start"))
    succ = first.join(nxt, "object").where("next_start > start and successor <> subject")
    best = T.first_unique(succ, ["subject", "object", "start"], "next_start", "successor")
    held = J.first_per(f.where("property = 'view'").where(T.holds_at(F.col("start"), F.col("end"), _cutoff())).select("subject", F.col("object").alias("held"), F.col("start").alias("held_since"), "fact_id"), ["subject"], [F.desc("held_since"), "fact_id"])
    return best.join(held, "subject").select("subject", "object", "start", "next_start", "successor", "held", "held_since")


_add("jn07_office_succession", jn07, oracle(FACTS, """first AS (SELECT subject, start, min(object) AS object FROM (SELECT *, min(start) OVER (PARTITION BY subject) AS m FROM facts WHERE property = 'click' AND start > DATE '2024-01-10' AND start <= DATE '2024-01-25') WHERE start = m GROUP BY 1, 2 HAVING count(DISTINCT object) = 1)""",
"n AS (SELECT a.subject, a.object, a.start, b.start AS next_start, b.subject AS successor, min(b.start) OVER (PARTITION BY a.subject, a.object, a.start) AS m FROM first a JOIN facts b ON b.property = 'click' AND b.object = a.object AND b.start > a.start AND b.subject <> a.subject)",
"best AS (SELECT subject, object, start, next_start, min(successor) AS successor FROM n WHERE next_start = m GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT successor) = 1)",
"""held AS (SELECT * FROM (SELECT subject, object AS held, start AS held_since, row_number() OVER (PARTITION BY subject ORDER BY start DESC, fact_id) AS rn FROM facts WHERE property = 'view' AND start <= DATE '2024-01-10' AND ("end" IS NULL OR "end" >= DATE '2024-01-10')) WHERE rn = 1)""",
     body="SELECT subject, object, start, next_start, successor, held, held_since FROM best JOIN held USING (subject)"))


def jn08(s, d):
    f = V.facts(s, d)
    move = T.first_unique(f.where("property = 'signup' and start > date '2024-01-10'"), ["subject"], "start", "object")
    lead = T.first_unique(f.where("property in ('click', 'view') and start > date '2024-01-10'"), ["object"], "start", "subject").select("object", F.col("start").alias("lead_start"), F.col("subject").alias("leader"))
    return move.join(lead, "object").where("lead_start >= start")


_add("jn08_mixed_topology", jn08, oracle(FACTS, "mv AS (SELECT subject, start, min(object) AS object FROM (SELECT *, min(start) OVER (PARTITION BY subject) AS m FROM facts WHERE property = 'signup' AND start > DATE '2024-01-10') WHERE start = m GROUP BY 1, 2 HAVING count(DISTINCT object) = 1)",
     "ld AS (SELECT object, start AS lead_start, min(subject) AS leader FROM (SELECT *, min(start) OVER (PARTITION BY object) AS m FROM facts WHERE property IN ('click', 'view') AND start > DATE '2024-01-10') WHERE start = m GROUP BY 1, 2 HAVING count(DISTINCT subject) = 1)", body="SELECT object, subject, start, lead_start, leader FROM mv JOIN ld USING (object) WHERE lead_start >= start"))


def _points(s, d):
    return V.table(s, d, "customer").select(F.col("c_custkey").alias("page"), T.end_of_day(F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 1500).cast("int"))).alias("at"))


POINTS = "points AS (SELECT c_custkey AS page, CAST(DATE '1996-01-01' + CAST(c_custkey % 1500 AS INTEGER) AS TIMESTAMP) + INTERVAL '86399 seconds' AS at_ts FROM customer)"
_add("jn09_as_of", lambda s, d: T.as_of(_points(s, d), V.revisions(s, d), "page", "at", "ts", "revision_id").select("page", "version.revision_id", "version.size"),
     oracle(REVISIONS, POINTS, body="SELECT page, arg_max(revision_id, (ts, revision_id)) AS revision_id, arg_max(size, (ts, revision_id)) AS size FROM points LEFT JOIN revisions r USING (page) WHERE r.ts <= at_ts GROUP BY 1 UNION ALL SELECT page, NULL, NULL FROM points p WHERE NOT EXISTS (SELECT 1 FROM revisions r WHERE r.page = p.page AND r.ts <= p.at_ts)"))


def jn10(s, d):
    r = V.revisions(s, d)
    before = r.select("page", "revision_id", "size", T.end_of_day(F.date_sub(F.to_date("ts"), 1)).alias("at"))
    prior = r.select("page", F.col("revision_id").alias("prior_id"), F.col("size").alias("prior_size"), "ts")
    return T.as_of(before, prior, "page", "at", "ts", "prior_id").select("revision_id", F.col("version.prior_id").alias("prior_id"), (F.col("version").isNull() | (F.col("size") > F.col("version.prior_size"))).alias("novel"))


_add("jn10_prior_state", jn10, oracle(REVISIONS, "p AS (SELECT a.revision_id, max(b.ts) AS ts, arg_max(b.revision_id, (b.ts, b.revision_id)) AS prior_id, arg_max(b.size, (b.ts, b.revision_id)) AS prior_size FROM revisions a JOIN revisions b ON a.page = b.page AND b.ts < CAST(CAST(a.ts AS DATE) AS TIMESTAMP) GROUP BY 1)",
     body="SELECT a.revision_id, prior_id, prior_id IS NULL OR a.size > prior_size AS novel FROM revisions a LEFT JOIN p USING (revision_id)"))


def jn11(s, d):
    r = V.revisions(s, d)
    ev = _points(s, d).select("page", F.to_date("at").alias("day"))
    return J.first_offset(ev, r, "page", "day", [0, 1, 3, 7], F.col("version.size") % 5 == 0, "ts", "revision_id").select("page", "day", F.col("offset").cast("long").alias("offset_days"))


_add("jn11_offset_probe", jn11, oracle(REVISIONS, POINTS, "probe AS (SELECT page, CAST(at_ts AS DATE) AS day, o, at_ts + o * INTERVAL '1 day' AS t FROM points, (VALUES (0), (1), (3), (7)) v(o))",
     "got AS (SELECT p.page, p.day, p.o, arg_max(size, (ts, revision_id)) AS size FROM probe p JOIN revisions r ON r.page = p.page AND r.ts <= p.t GROUP BY 1, 2, 3)", body="SELECT page, day, CAST(min(o) AS BIGINT) AS offset_days FROM got WHERE size % 5 = 0 GROUP BY 1, 2"))
_add("jn12_link_exists", lambda s, d: V.links(s, d).select("source", "target").join(V.links(s, d).select(F.col("target").alias("source"), F.col("source").alias("target")), ["source", "target"], "left_semi"),
     oracle(LINKS, body="SELECT source, target FROM links a WHERE EXISTS (SELECT 1 FROM links b WHERE b.source = a.target AND b.target = a.source)"))


def jn13(s, d):
    w = Window.partitionBy("target").orderBy("pos", "source")
    return V.links(s, d).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("target", "source", "place")


_add("jn13_backlinks", jn13, oracle(LINKS, body="SELECT target, source, place FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY pos, source) AS place FROM links) WHERE place <= 5"))
_add("jn14_claims_with_links", lambda s, d: V.facts(s, d).where("rank = 'preferred'").select("subject", "object").distinct().join(V.links(s, d).select(F.col("source").alias("subject"), F.col("target").alias("object")), ["subject", "object"]),
     oracle(FACTS, LINKS, body="SELECT DISTINCT subject, object FROM facts JOIN links ON source = subject AND target = object WHERE rank = 'preferred'"))
_add("jn15_version_pairs", lambda s, d: J.version_pairs(V.revisions(s, d), "page", "revision_id", 12),
     oracle(REVISIONS, "n AS (SELECT page, count(DISTINCT revision_id) AS n FROM revisions GROUP BY page)", body="SELECT a.page, a.revision_id AS a, b.revision_id AS b FROM revisions a JOIN revisions b ON a.page = b.page AND a.revision_id <> b.revision_id JOIN n ON a.page = n.page WHERE n <= 12 UNION ALL SELECT DISTINCT page, revision_id, NULL FROM revisions JOIN n USING (page) WHERE n > 12"))
_add("jn16_stub_join", lambda s, d: J.stub_join(V.links(s, d).select("source", "target"), V.table(s, d, "supplier").select("s_suppkey"), "target", "s_suppkey", 30).select("source", "target", "kind"),
     oracle(LINKS, "u AS (SELECT DISTINCT target FROM links WHERE target NOT IN (SELECT s_suppkey FROM supplier) ORDER BY target LIMIT 30)", body="SELECT source, target, CASE WHEN target IN (SELECT s_suppkey FROM supplier) THEN 'node' WHEN target IN (SELECT target FROM u) THEN 'stub' ELSE 'external' END AS kind FROM links"))


def jn17(s, d):
    nodes = V.revisions(s, d).where("revision_id % 3 = 0").select(F.col("revision_id").alias("node"), F.col("page").alias("title"), F.col("revision_id").alias("exact"), F.col("status").alias("group"))
    return J.resolve_cascade(V.revisions(s, d).select("revision_id", "page", "status"), nodes, "page", "revision_id", "status").select("revision_id", "node")


_add("jn17_resolution_cascade", jn17, oracle(REVISIONS, "n AS (SELECT * FROM revisions WHERE revision_id % 3 = 0)", "g AS (SELECT page, status, min(revision_id) AS n2 FROM n GROUP BY 1, 2)", "u AS (SELECT page, min(revision_id) AS n3 FROM n GROUP BY 1 HAVING count(*) = 1)",
     body="SELECT r.revision_id, coalesce(n.revision_id, n2, n3) AS node FROM revisions r LEFT JOIN n USING (revision_id) LEFT JOIN g ON g.page = r.page AND g.status = r.status LEFT JOIN u ON u.page = r.page"))


def jn18(s, d):
    log = V.log(s, d)
    rep = log.groupBy("model", "case_id").agg(F.min("line_no").alias("rep"))
    gate = log.where("slot = 'gate'").select(F.col("line_no").alias("rep"), "label")
    return log.select("line_no", "model", "case_id").join(rep, ["model", "case_id"]).join(gate, "rep", "left").select("line_no", F.when(F.col("label").isNull(), "pending").when(F.col("label") == "correct", "pass").otherwise("fail").alias("gate"))


_add("jn18_inherited_gate", jn18, oracle(LOG, "r AS (SELECT *, min(line_no) OVER (PARTITION BY model, case_id) AS rep FROM log)", body="SELECT r.line_no, CASE WHEN g.label IS NULL THEN 'pending' WHEN g.label = 'correct' THEN 'pass' ELSE 'fail' END AS gate FROM r LEFT JOIN log g ON g.line_no = r.rep AND g.slot = 'gate'"))


def jn19(s, d):
    log = V.log(s, d)
    last = lambda slot, name: log.where(F.col("slot") == slot).groupBy("model", "case_id").agg(F.max_by("label", "line_no").alias(name))
    return last("ripple", "judgment").join(last("control", "summary"), ["model", "case_id"], "left").join(last("gate", "gate"), ["model", "case_id"], "left")


_add("jn19_log_views", jn19, oracle(LOG, "v AS (SELECT model, case_id, slot, arg_max(label, line_no) AS label FROM log GROUP BY 1, 2, 3)", body="SELECT j.model, j.case_id, j.label AS judgment, s.label AS summary, g.label AS gate FROM v j LEFT JOIN v s ON s.model = j.model AND s.case_id = j.case_id AND s.slot = 'control' LEFT JOIN v g ON g.model = j.model AND g.case_id = j.case_id AND g.slot = 'gate' WHERE j.slot = 'ripple'"))


def jn20(s, d):
    log = V.log(s, d)
    g = log.where("slot = 'gate' and k > 60").groupBy("model", "case_id").agg(F.count("*").alias("gates"))
    j = log.where("slot = 'ripple' and k > 60").groupBy("model", "case_id").agg(F.count("*").alias("judged"), F.count_if(F.col("label") == "correct").alias("correct"))
    return J.score_cells(g, j, ["model", "case_id"], ["gates", "judged", "correct"])


_add("jn20_score_cells", jn20, oracle(LOG, body="SELECT model, case_id, count(*) FILTER (WHERE slot = 'gate') AS gates, count(*) FILTER (WHERE slot = 'ripple') AS judged, count(*) FILTER (WHERE slot = 'ripple' AND label = 'correct') AS correct FROM log WHERE slot IN ('gate', 'ripple') AND k > 60 GROUP BY 1, 2"))


def jn21(s, d):
    c = V.log(s, d).where("slot in ('ripple', 'control')").groupBy("model", "distance", "occurrence").pivot("arm", ["conflict", "control"]).count()
    return c.where("conflict > 0 and control > 0")


_add("jn21_paired_cells", jn21, oracle(LOG, body="SELECT model, distance, occurrence, count(*) FILTER (WHERE arm = 'conflict') AS conflict, count(*) FILTER (WHERE arm = 'control') AS control FROM log WHERE slot IN ('ripple', 'control') GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE arm = 'conflict') > 0 AND count(*) FILTER (WHERE arm = 'control') > 0"))


def jn22(s, d):
    cases = V.table(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    reviews = V.table(s, d, "labels").select("doc_id", "quality", F.when(F.col("doc_id") % 9 == 0, F.lit("stale")).alias("stale"))
    return cases.join(reviews, "doc_id", "left").select("doc_id", F.when(F.col("quality").isNull(), "unreviewed").when(F.col("stale").isNotNull(), "hash_mismatch").when(F.col("quality") == 0, "rejected").otherwise("approved").alias("review"), F.substring("h", 1, 12).alias("case_hash"))


_add("jn22_reviews", jn22, "SELECT doc_id, CASE WHEN quality IS NULL THEN 'unreviewed' WHEN doc_id % 9 = 0 THEN 'hash_mismatch' WHEN quality = 0 THEN 'rejected' ELSE 'approved' END AS review, substring(sha256(coalesce(text, '')), 1, 12) AS case_hash FROM documents LEFT JOIN labels USING (doc_id)")


def jn23(s, d):
    cited = V.anchors(s, d).select("page_id", F.lower("target").alias("w")).distinct()
    wit = V.table(s, d, "pages").select("page_id", F.lower("html").alias("h"))
    return cited.join(wit, "page_id").where(F.contains(F.col("h"), F.concat(F.lit(" "), F.col("w"), F.lit(" ")))).select("page_id", "w")


_add("jn23_witnesses", jn23, oracle(ANCHORS, body="SELECT DISTINCT a.page_id, lower(a.target) AS w FROM anchors a JOIN pages p USING (page_id) WHERE contains(lower(p.html), ' ' || lower(a.target) || ' ')"))


def jn24(s, d):
    t = V.turns(s, d)
    probe = t.where("action = 'user'").select("attempt", F.col("step").alias("p"), F.substring_index("text", " ", 1).alias("w"))
    page = t.where("action = 'assistant'").select("attempt", F.col("step").alias("p"), "text").withColumn("p", F.col("p") - 1)
    return probe.join(page, ["attempt", "p"]).groupBy("attempt").agg(F.bool_and(F.contains(F.lower("text"), F.lower("w"))).alias("supported"), F.count("*").alias("n"))


_add("jn24_bridge_evidence", jn24, oracle(TURNS, body="SELECT attempt, bool_and(contains(lower(b.text), lower(split_part(a.text, ' ', 1)))) AS supported, count(*) AS n FROM turns a JOIN turns b USING (attempt) WHERE a.action = 'user' AND b.action = 'assistant' AND b.step - 1 = a.step GROUP BY 1"))


def jn25(s, d):
    log = V.log(s, d)
    want = log.where("slot = 'pk'").select("model", "case_id").distinct()
    stage = log.groupBy("model", "case_id").agg(*(F.bool_or(F.expr(e)).alias(n) for n, e in (("legal", "slot = 'control'"), ("scored", "slot = 'control' and k > 30"), ("expanded", "slot = 'control' and k > 60"))))
    return want.join(stage, ["model", "case_id"], "left")


_add("jn25_action_funnel", jn25, oracle(LOG, body="SELECT model, case_id, bool_or(slot = 'control') AS legal, bool_or(slot = 'control' AND k > 30) AS scored, bool_or(slot = 'control' AND k > 60) AS expanded FROM log GROUP BY 1, 2 HAVING bool_or(slot = 'pk')"))


def jn26(s, d):
    claim = T.single_target(V.facts(s, d).where("rank = 'preferred'"), ["subject", "property"], "object")
    pop = V.facts(s, d).groupBy("object").agg(F.count("*").alias("views"))
    return claim.join(pop, "object").join(V.links(s, d).select(F.col("source").alias("subject"), F.col("target").alias("object")), ["subject", "object"], "left_semi").select("subject", "property", "object", "views")


_add("jn26_tail_targets", jn26, oracle(FACTS, LINKS, "c AS (SELECT subject, property, min(object) AS object FROM facts WHERE rank = 'preferred' GROUP BY 1, 2 HAVING count(DISTINCT object) = 1)", body="SELECT c.*, (SELECT count(*) FROM facts f WHERE f.object = c.object) AS views FROM c WHERE EXISTS (SELECT 1 FROM links WHERE source = subject AND target = object)"))


def jn27(s, d):
    prof = V.log(s, d).groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "correct").alias("ok"))
    reg = s.createDataFrame([("click", "active"), ("view", "active"), ("signup", "quarantine")], "model string, status string")
    return prof.join(reg, "model").select("model", "n", "ok", ((F.col("status") == "active") & (F.col("ok") * 5 >= F.col("n"))).alias("admitted"))


_add("jn27_relation_admission", jn27, oracle(LOG, "r AS (SELECT * FROM (VALUES ('click', 'active'), ('view', 'active'), ('signup', 'quarantine')) v(model, status))", body="SELECT model, count(*) AS n, count(*) FILTER (WHERE label = 'correct') AS ok, any_value(status) = 'active' AND count(*) FILTER (WHERE label = 'correct') * 5 >= count(*) AS admitted FROM log JOIN r USING (model) GROUP BY 1"))


def jn28(s, d):
    hops = V.turns(s, d).select(F.col("attempt").alias("case"), F.col("step").alias("hop"), (1 + F.col("attempt") % 100).alias("source"), (1 + (F.col("attempt") * 3 + F.col("step")) % 200).alias("target"))
    return J.lookahead_links(hops, V.links(s, d)).select(F.col("case").alias("case_id"), "i", "j")


_add("jn28_shortcuts", jn28, oracle(LINKS, "h AS (SELECT conv_id AS c, turn AS hop, 1 + conv_id % 100 AS source, 1 + (conv_id * 3 + turn) % 200 AS target FROM conversations)", body="SELECT a.c AS case_id, a.hop AS i, b.hop AS j FROM h a JOIN h b ON a.c = b.c AND b.hop > a.hop WHERE EXISTS (SELECT 1 FROM links l WHERE l.source = a.source AND l.target = b.target)"))


def jn29(s, d):
    at = V.revisions(s, d).groupBy("page").agg(F.max_by("size", F.struct("ts", "revision_id")).alias("size"))
    edge = V.links(s, d).select(F.col("source").alias("page"), "target")
    return edge.join(at, "page").where("size % 2 = 0").select("page", "target")


_add("jn29_initial_edge", jn29, oracle(REVISIONS, LINKS, "a AS (SELECT page, arg_max(size, (ts, revision_id)) AS size FROM revisions GROUP BY 1)", body="SELECT page, target FROM links JOIN a ON source = page WHERE size % 2 = 0"))


def jn30(s, d):
    one = T.single_target(V.facts(s, d).where("rank = 'preferred'"), ["subject", "property"], "object")
    names = V.table(s, d, "part").select(F.col("p_partkey").alias("object"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("title"), F.col("p_brand").alias("name"))
    return one.join(names, "object").select("subject", "property", "object", F.coalesce("title", "name").alias("label"))


_add("jn30_claim_targets", jn30, oracle(FACTS, "c AS (SELECT subject, property, min(object) AS object FROM facts WHERE rank = 'preferred' GROUP BY 1, 2 HAVING count(DISTINCT object) = 1)", body="SELECT subject, property, object, coalesce(CASE WHEN p_size > 25 THEN p_name END, p_brand) AS label FROM c JOIN part ON p_partkey = object"))
