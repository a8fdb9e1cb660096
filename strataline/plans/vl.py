"""Validation, judge-gate and incremental operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataline.operators import ordering as O
from strataline.operators import submissions as SU
from strataline.operators import validation as C
from strataline.sources import views as V
from strataline.sources.views import FACTS, LOG, REVISIONS, TURNS, oracle

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _low():
    return F.lit("2024-01-10").cast("date")


def _high():
    return F.lit("2024-01-20").cast("date")


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _certificates(s, d):
    return C.certificate(V.facts(s, d), ["subject", "property"], "start", "object", _low(), _high())


CERT = """c AS (SELECT DISTINCT subject, property, start, object FROM facts WHERE start > DATE '2024-01-10' AND start <= DATE '2024-01-20'),
g AS (SELECT subject, property, min(start) AS selected_date, sha256(string_agg(CAST(start AS VARCHAR) || '|' || CAST(object AS VARCHAR), ';' ORDER BY start, object)) AS digest FROM c GROUP BY 1, 2),
f AS (SELECT g.subject, g.property, selected_date, digest, CASE WHEN count(*) = 1 THEN min(object) END AS selected FROM g JOIN c ON c.subject = g.subject AND c.property = g.property AND c.start = selected_date GROUP BY 1, 2, 3, 4)"""
_add("vl01_certificate", lambda s, d: _certificates(s, d).drop("candidates"), oracle(FACTS, CERT, body="SELECT subject, property, selected, selected_date, digest FROM f"))
_add("vl02_certificate_errors", lambda s, d: _certificates(s, d).select("subject", "property", F.array_join(C.certificate_errors("start", "object", _low(), F.col("subject") % 100), ",").alias("errors")),
     oracle(FACTS, CERT, body="SELECT subject, property, concat_ws(',', CASE WHEN selected IS NULL THEN 'ambiguous' END, CASE WHEN selected IS NULL OR selected <> subject % 100 THEN 'unexpected' END) AS errors FROM f"))


def _hops(s, d):
    f = V.facts(s, d).where("property = 'purchase'")
    w = Window.partitionBy("subject").orderBy("start", "fact_id")
    return f.select(F.col("subject").alias("chain"), F.col("fact_id").alias("hop"), (F.col("object") % 10).alias("source"), (F.lead("object").over(w) % 10).alias("target"), "start").where("target is not null")


HOPS = "h AS (SELECT * FROM (SELECT subject AS chain, fact_id AS hop, object % 10 AS source, lead(object) OVER (PARTITION BY subject ORDER BY start, fact_id) % 10 AS target, start FROM facts WHERE property = 'purchase') WHERE target IS NOT NULL)"
_add("vl03_chain_errors", lambda s, d: C.chain_errors(_hops(s, d), "chain", "hop", "source", "target", "start").select("chain", "hops", F.array_join("errors", ",").alias("errors")),
     oracle(FACTS, HOPS, "x AS (SELECT *, lag(target) OVER w AS t, lag(start) OVER w AS dd, row_number() OVER (PARTITION BY chain, source, target ORDER BY hop) AS e FROM h WINDOW w AS (PARTITION BY chain ORDER BY hop))",
     body="SELECT chain, count(*) AS hops, concat_ws(',', CASE WHEN bool_or(t IS NOT NULL AND t <> source) THEN 'disconnected' END, CASE WHEN bool_or(dd IS NOT NULL AND dd >= start) THEN 'date_order' END, CASE WHEN bool_or(e > 1) THEN 'repeated_edge' END) AS errors FROM x GROUP BY 1"))
_add("vl04_validity_contract", lambda s, d: V.log(s, d).groupBy("case_id").agg(F.bool_and(F.col("k") < 99).alias("a"), F.bool_or(F.col("label") == "correct").alias("b"), (F.count("*") > 40).alias("c")).select("case_id", C.all_checks(["a", "b", "c"]).alias("valid")),
     oracle(LOG, body="SELECT case_id, bool_and(k < 99) AND bool_or(label = 'correct') AND count(*) > 40 AS valid FROM log GROUP BY 1"))
_add("vl05_seed_parsing", lambda s, d: V.turns(s, d).groupBy("attempt").agg(F.count("*").alias("n"), F.min("step").alias("first"), F.max("step").alias("last")).select("attempt", F.array_join(C.errors(("hop_count", ~F.col("n").between(2, 6)), ("gap", F.col("last") - F.col("first") + 1 != F.col("n"))), ",").alias("errors")),
     oracle(TURNS, body="SELECT attempt, concat_ws(',', CASE WHEN NOT count(*) BETWEEN 2 AND 6 THEN 'hop_count' END, CASE WHEN max(step) - min(step) + 1 <> count(*) THEN 'gap' END) AS errors FROM turns GROUP BY 1"))
_add("vl06_case_validation", lambda s, d: V.table(s, d, "documents").withColumn("copies", F.count("*").over(Window.partitionBy(F.sha2("text", 256)))).select("doc_id", F.array_join(C.errors(("duplicate", F.col("copies") > 1), ("length", F.col("n_chars") != F.length("text")), ("language", ~F.col("lang").isin("en", "fr", "de"))), ",").alias("errors")),
     "SELECT doc_id, concat_ws(',', CASE WHEN count(*) OVER (PARTITION BY sha256(text)) > 1 THEN 'duplicate' END, CASE WHEN n_chars <> length(text) THEN 'length' END, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'language' END) AS errors FROM documents")
_add("vl07_candidate_validation", lambda s, d: V.turns(s, d).where("action = 'user'").select("attempt", "step", F.array_join(C.errors(("no_the", ~F.contains(F.lower("text"), F.lit("the"))), ("short", F.length("text") < 40)), ",").alias("errors")),
     oracle(TURNS, body="SELECT attempt, step, concat_ws(',', CASE WHEN NOT contains(lower(text), 'the') THEN 'no_the' END, CASE WHEN length(text) < 40 THEN 'short' END) AS errors FROM turns WHERE action = 'user'"))
_add("vl08_excerpt_hash", lambda s, d: V.table(s, d, "benchmark").select("item_id", (F.sha2("text", 256) == F.sha2(F.trim("text"), 256)).alias("ok")), "SELECT item_id, sha256(text) = sha256(trim(text)) AS ok FROM benchmark")


def _case_facts(s, d):
    """The first four facts of a subject, by date: three required claims and the tail."""
    f = V.facts(s, d).withColumn("pos", F.row_number().over(Window.partitionBy("subject").orderBy("start", "fact_id"))).where("pos <= 4")
    return f.select(F.col("subject").alias("case"), (F.col("pos") - 1).cast("int").alias("pos"), F.when(F.col("pos") == 4, F.lit("tail")).otherwise(F.format_string("c%d", F.col("pos") - 1)).alias("claim_id"),
                    F.when(F.col("pos") == 4, F.lit("bridge")).otherwise(F.lit("case")).alias("subject"), F.col("property").alias("relation"), F.when(F.col("pos") == 3, F.lit("bridge")).otherwise(F.concat(F.lit("Object "), F.col("object").cast("string"))).alias("object"),
                    F.date_format("start", "yyyy-MM-dd").alias("event_time"), "fact_id")


def vl09(s, d):
    """Submissions made of the facts: some claims unnamed, some with another object or time, some evidence not owned or without a witness."""
    f, n = _case_facts(s, d), F.col("fact_id")
    required = f.drop("fact_id")
    evidence_id = F.concat(F.lit("e"), n.cast("string"))
    claims = f.select("case", (10 - F.col("pos")).alias("pos"), F.when((n % 3 != 0) | (F.col("claim_id") == "tail"), F.col("claim_id")).alias("claim_id"), F.upper("subject").alias("subject"), "relation",
                      F.when(n % 7 == 0, F.lit("another")).otherwise(F.concat(F.lit(" "), F.col("object"))).alias("object"), F.when(n % 11 == 0, F.lit("2000-01-01")).otherwise(F.col("event_time")).alias("event_time"), F.array(evidence_id).alias("cited"))
    cases = f.where("claim_id = 'tail'").select("case", F.col("object").alias("answer"), F.when(n % 5 == 0, F.array(F.lit("nobody"))).otherwise(F.array(F.lower("object"), F.lit("it"))).alias("aliases"), (n % 17 != 0).alias("actions_valid"))
    evidence = f.where(n % 13 != 0).select("case", evidence_id.alias("evidence_id"), F.concat(F.lit("It says "), F.col("object"), F.lit(".")).alias("content"))
    witnesses = f.where(n % 4 != 1).select("case", "claim_id", evidence_id.alias("evidence_id"))
    decisions = f.where(n % 4 == 1).select("case", "claim_id", (n % 8 == 1).alias("supported"))
    last = F.col("claim_id") == "tail"
    matched = SU.match_claims(required, claims).withColumn("tail", last)
    return SU.validate_submissions(SU.claim_results(matched, cases, evidence, witnesses, decisions), cases)


_add("vl09_submission", vl09, oracle(FACTS, """f AS (SELECT *, pos = 4 AS tail, CASE WHEN pos = 3 THEN 'bridge' ELSE 'Object ' || CAST(object AS VARCHAR) END AS obj
    FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY start, fact_id) AS pos FROM facts) WHERE pos <= 4)""",
    "cases AS (SELECT subject AS \"case\", fact_id % 17 <> 0 AS actions_valid, fact_id % 5 <> 0 AS answer_correct FROM f WHERE tail)",
    # claims of equal shape that are unnamed are taken from the end, as their places run backwards
    """u AS (SELECT *, fact_id % 3 <> 0 OR tail AS named, row_number() OVER (PARTITION BY subject, tail, property, obj, fact_id % 3 <> 0 OR tail ORDER BY pos) AS rn FROM f)""",
    """l AS (SELECT *, row_number() OVER (PARTITION BY subject, tail, property, obj ORDER BY pos DESC) AS rn FROM u WHERE NOT named AND fact_id % 7 <> 0)""",
    """m AS (SELECT u.*, CASE WHEN u.named THEN u.fact_id ELSE l.fact_id END AS said, CASE WHEN u.named THEN u.start ELSE l.start END AS said_start
    FROM u LEFT JOIN l ON l.subject = u.subject AND l.property = u.property AND l.obj = u.obj AND l.tail = u.tail AND l.rn = u.rn)""",
    """r AS (SELECT *, coalesce(said % 7 <> 0, false) AS shape, coalesce(said % 13 <> 0, false) AS owned,
    coalesce(CASE WHEN fact_id % 4 <> 1 THEN said = fact_id ELSE fact_id % 8 = 1 END, false) AS seen, coalesce(said % 11 <> 0 AND said_start = start, false) AS in_time FROM m)""",
    "p AS (SELECT *, shape AND owned AND seen AND in_time AS passed FROM r)",
    """g AS (SELECT subject, count(*) FILTER (NOT tail) AS bridges, count(*) FILTER (NOT tail AND passed) AS acquired, coalesce(bool_and(passed) FILTER (NOT tail), false) AS complete, coalesce(bool_and(in_time) FILTER (NOT tail), false) AS temporal,
    coalesce(bool_or(passed) FILTER (tail), false) AS tail_passed, coalesce(bool_or(shape) FILTER (tail), false) AS tail_shape, coalesce(bool_or(owned) FILTER (tail), false) AS literal FROM p GROUP BY 1)""",
    "o AS (SELECT \"case\", bridges, acquired, actions_valid, answer_correct, literal, complete, tail_passed, temporal, bridges = 3 AND tail_shape AND answer_correct AS composed FROM cases JOIN g ON g.subject = \"case\")",
    body="SELECT *, actions_valid AND answer_correct AND literal AND complete AND tail_passed AND temporal AND composed AS success FROM o"))
_add("vl10_compact_submission", lambda s, d: V.log(s, d).where("slot = 'gate'").groupBy("case_id").agg(F.collect_set("k").alias("cited")).join(V.log(s, d).where("slot = 'pk'").groupBy("case_id").agg(F.collect_set("k").alias("owned")), "case_id").select("case_id", F.size(F.array_except("cited", "owned")).cast("long").alias("foreign")),
     oracle(LOG, "o AS (SELECT DISTINCT case_id, k FROM log WHERE slot = 'pk')", "c AS (SELECT DISTINCT case_id, k FROM log WHERE slot = 'gate')", body='SELECT c.case_id, count(*) FILTER (WHERE o.k IS NULL) AS "foreign" FROM c LEFT JOIN o ON o.case_id = c.case_id AND o.k = c.k WHERE c.case_id IN (SELECT case_id FROM o) GROUP BY 1'))


def vl11(s, d):
    gate = O.last_wins(V.log(s, d).where("slot = 'gate'"), ["model", "case_id"], "line_no").select("model", "case_id", "label", "k")
    return V.log(s, d).select("model", "case_id").distinct().join(gate, ["model", "case_id"], "left").select("model", "case_id", F.coalesce((F.col("label") != "other") & (F.col("k") <= 60), F.lit(False)).alias("admitted"))


_add("vl11_formal_admission", vl11, oracle(LOG, "g AS (SELECT model, case_id, arg_max(label, line_no) AS label, arg_max(k, line_no) AS k FROM log WHERE slot = 'gate' GROUP BY 1, 2)", body="SELECT model, case_id, coalesce(label <> 'other' AND k <= 60, false) AS admitted FROM (SELECT DISTINCT model, case_id FROM log) LEFT JOIN g USING (model, case_id)"))
_add("vl12_freeze", lambda s, d: C.manifest_mismatch(V.table(s, d, "documents").where("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("h")), V.table(s, d, "documents").where("doc_id % 5 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 11 == 0, F.lit("x")).otherwise(F.col("text")), 256).alias("h")), "doc_id", "h"),
     "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'unexpected' ELSE 'differs' END AS state FROM documents WHERE (doc_id % 7 = 0) <> (doc_id % 5 = 0) OR (doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 11 = 0)")
_add("vl13_config_lock", lambda s, d: V.log(s, d).groupBy("case_id").agg(F.sha2(F.min_by("contract_hash", "line_no"), 256).alias("locked"), F.count_if(F.lit(True)).alias("runs"), (F.countDistinct("contract_hash") == 1).alias("unchanged")),
     oracle(LOG, body="SELECT case_id, sha256(arg_min(contract_hash, line_no)) AS locked, count(*) AS runs, count(DISTINCT contract_hash) = 1 AS unchanged FROM log GROUP BY 1"))


def vl14(s, d):
    w = Window.partitionBy("chain").orderBy("hop")
    return _hops(s, d).select("chain", "hop", F.when(F.lag("target").over(w).isNull(), "first").when(F.lag("target").over(w) != F.col("source"), "disconnected").when(F.lag("start").over(w) >= F.col("start"), "not_later").otherwise("ok").alias("state"))


_add("vl14_adjacent_hops", vl14, oracle(FACTS, HOPS, body="SELECT chain, hop, CASE WHEN lag(target) OVER w IS NULL THEN 'first' WHEN lag(target) OVER w <> source THEN 'disconnected' WHEN lag(start) OVER w >= start THEN 'not_later' ELSE 'ok' END AS state FROM h WINDOW w AS (PARTITION BY chain ORDER BY hop)"))


def vl15(s, d):
    want = O.ranked(_hops(s, d), ["chain"], ["hop"], "i").select("chain", F.col("i").cast("long").alias("i"), "target")
    have = O.ranked(_hops(s, d).where("hop % 13 <> 0"), ["chain"], ["hop"], "i").select("chain", F.col("i").cast("long").alias("i"), F.col("target").alias("stored"))
    return want.join(have, ["chain", "i"], "full").where("not target <=> stored").select("chain", "i")


_add("vl15_waypoint_alignment", vl15, oracle(FACTS, HOPS, "w AS (SELECT chain, target, row_number() OVER (PARTITION BY chain ORDER BY hop) AS i FROM h)", "v AS (SELECT chain, target, row_number() OVER (PARTITION BY chain ORDER BY hop) AS i FROM h WHERE hop % 13 <> 0)", body="SELECT coalesce(w.chain, v.chain) AS chain, coalesce(w.i, v.i) AS i FROM w FULL JOIN v ON w.chain = v.chain AND w.i = v.i WHERE w.target IS DISTINCT FROM v.target"))
_add("vl16_frozen_evidence", lambda s, d: V.revisions(s, d).select("page", "revision_id").join(V.revisions(s, d).where("size % 2 = 0").select("revision_id", F.sha2(F.col("size").cast("string"), 256).alias("h")), "revision_id", "left").select("revision_id", F.when(F.col("h").isNull(), "not_frozen").otherwise(F.substring("h", 1, 8)).alias("state")),
     oracle(REVISIONS, body="SELECT revision_id, CASE WHEN size % 2 = 0 THEN substring(sha256(CAST(size AS VARCHAR)), 1, 8) ELSE 'not_frozen' END AS state FROM revisions"))
_add("vl17_primary_probes", lambda s, d: V.log(s, d).groupBy("case_id").agg(F.collect_set(F.when(F.col("slot") == "pk", F.col("model"))).alias("a"), F.collect_set(F.when((F.col("slot") == "gate") & (F.col("k") > 40), F.col("model"))).alias("b")).select("case_id", C.set_equal(F.col("a"), F.col("b")).alias("ok")),
     oracle(LOG, body="SELECT case_id, count(*) FILTER (WHERE slot = 'pk') > 0 AND coalesce(string_agg(DISTINCT model, ',' ORDER BY model) FILTER (WHERE slot = 'pk'), '') = coalesce(string_agg(DISTINCT model, ',' ORDER BY model) FILTER (WHERE slot = 'gate' AND k > 40), '') AS ok FROM log GROUP BY 1"))
_add("vl18_sentence_length", lambda s, d: V.turns(s, d).select("attempt", "step", F.array_join(C.sentence_errors(F.col("text"), F.lit(3), 12), ",").alias("errors")),
     oracle(TURNS, "x AS (SELECT attempt, step, [trim(z, ' ' || chr(10)) FOR z IN regexp_split_to_array(text, '[.!?]+') IF trim(z, ' ' || chr(10)) <> ''] AS p FROM turns)", body="SELECT attempt, step, concat_ws(',', CASE WHEN len(p) < 3 THEN 'few_sentences' END, CASE WHEN len([z FOR z IN p IF len(regexp_split_to_array(z, '\\s+')) > 12]) > 0 THEN 'long_sentence' END) AS errors FROM x"))

# judges and scores: the deterministic part
_add("ml02_judge_gates", lambda s, d: V.turns(s, d).select("attempt", "step", F.when(~F.contains(F.lower("text"), F.lit("the")), "no_alias").when(F.length("text") % 10 < 3, "low_confidence").otherwise("accepted").alias("gate")),
     oracle(TURNS, body="SELECT attempt, step, CASE WHEN NOT contains(lower(text), 'the') THEN 'no_alias' WHEN length(text) % 10 < 3 THEN 'low_confidence' ELSE 'accepted' END AS gate FROM turns"))
_add("ml03_judge_schema", lambda s, d: V.log(s, d).select("line_no", F.create_map(F.lit("a"), F.col("k") > 5, F.lit("b"), F.col("label") != "other").alias("m")).select("line_no", F.forall(F.map_values("m"), lambda x: x).alias("passes")), oracle(LOG, body="SELECT line_no, k > 5 AND label <> 'other' AS passes FROM log"))
_add("ml06_mean_logprob", lambda s, d: V.log(s, d).groupBy("case_id").agg(F.collect_list("k").alias("x")).select("case_id", F.aggregate("x", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), F.size("x").cast("long").alias("n")), oracle(LOG, body="SELECT case_id, CAST(sum(k) AS BIGINT) AS total, count(*) AS n FROM log GROUP BY 1"))


def ml07(s, d):
    l = V.log(s, d).where("slot = 'gate'")
    mode = l.groupBy("model", "case_id").agg(F.avg(F.col("k") / 100.0).alias("m"))
    scored = O.log_softmax(l, ["model", "case_id"], F.col("k") / 100.0, "g").join(mode, ["model", "case_id"])
    return scored.select("line_no", F.round(F.col("g") + F.col("m"), 6).alias("score"))


_add("ml07_hierarchical_score", ml07, oracle(LOG, "x AS (SELECT line_no, model, case_id, k / 100.0 AS s, max(k / 100.0) OVER w AS m, avg(k / 100.0) OVER w AS a FROM log WHERE slot = 'gate' WINDOW w AS (PARTITION BY model, case_id))", body="SELECT line_no, round(s - m - ln(sum(exp(s - m)) OVER (PARTITION BY model, case_id)) + a, 6) AS score FROM x"))
_add("ml10_probe_contract", lambda s, d: V.facts(s, d).where("rank = 'preferred'").select("fact_id", F.explode(F.array(F.lit("anchor"), F.lit("bridge"), F.lit("tail"))).alias("role")).withColumn("must_be_unknown", F.col("role") != "anchor"), oracle(FACTS, body="SELECT fact_id, role, role <> 'anchor' AS must_be_unknown FROM facts, (VALUES ('anchor'), ('bridge'), ('tail')) v(role) WHERE rank = 'preferred'"))

# incremental behaviour, batch form
_add("sm01_resumable_todo", lambda s, d: V.log(s, d).select("model", "case_id").distinct().join(V.log(s, d).where("slot = 'gate' and label = 'correct'").select("model", "case_id").distinct(), ["model", "case_id"], "left_anti"),
     oracle(LOG, body="SELECT DISTINCT model, case_id FROM log EXCEPT SELECT model, case_id FROM log WHERE slot = 'gate' AND label = 'correct'"))
_add("sm02_idempotent_append", lambda s, d: O.first_wins(V.log(s, d), ["model", "case_id", "k"], ["line_no"]).select("model", "case_id", "k", "line_no"), oracle(LOG, body="SELECT model, case_id, k, min(line_no) AS line_no FROM log GROUP BY 1, 2, 3"))
_add("sm03_skip_checkpointed", lambda s, d: V.log(s, d).where("slot = 'pk'").select("line_no", "model", "case_id", "repeat").join(V.log(s, d).where("slot = 'gate'").select("model", "case_id", "repeat").distinct(), ["model", "case_id", "repeat"], "left_anti").select("line_no"),
     oracle(LOG, body="SELECT line_no FROM log a WHERE slot = 'pk' AND NOT EXISTS (SELECT 1 FROM log b WHERE b.slot = 'gate' AND b.model = a.model AND b.case_id = a.case_id AND b.repeat = a.repeat)"))
_add("sm04_latest_gate", lambda s, d: O.last_wins(V.log(s, d).where("slot = 'gate'"), ["model", "case_id", "contract_hash"], "line_no").select("model", "case_id", "contract_hash", "line_no", "label"),
     oracle(LOG, body="SELECT model, case_id, contract_hash, max(line_no) AS line_no, arg_max(label, line_no) AS label FROM log WHERE slot = 'gate' GROUP BY 1, 2, 3"))
_add("sm05_attempts_by_worker", lambda s, d: V.log(s, d).groupBy((F.col("case_id") % 8).alias("worker")).agg(F.count("*").alias("attempts")), oracle(LOG, body="SELECT case_id % 8 AS worker, count(*) AS attempts FROM log GROUP BY 1"))
_add("sm07_drift", lambda s, d: V.links(s, d).where("source % 2 = 0").groupBy("target").agg(F.count("*").alias("before_n")).join(V.links(s, d).where("source % 3 = 0").groupBy("target").agg(F.count("*").alias("after_n")), "target", "full").where("not before_n <=> after_n"),
     oracle(V.LINKS, "a AS (SELECT target, count(*) AS before_n FROM links WHERE source % 2 = 0 GROUP BY 1)", "b AS (SELECT target, count(*) AS after_n FROM links WHERE source % 3 = 0 GROUP BY 1)", body="SELECT coalesce(a.target, b.target) AS target, before_n, after_n FROM a FULL JOIN b ON a.target = b.target WHERE before_n IS DISTINCT FROM after_n"))
_add("sm08_run_eligibility", lambda s, d: V.log(s, d).groupBy("case_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("label") == "correct").alias("done")).where("done < 15").select("case_id", F.least(F.lit(600), (5 * F.pow(F.lit(2), F.least(F.col("attempts") % 10, F.lit(20)) - 1)).cast("long")).alias("delay")),
     oracle(LOG, body="SELECT case_id, least(600, CAST(floor(5 * pow(2, least(count(*) % 10, 20) - 1)) AS BIGINT)) AS delay FROM log GROUP BY 1 HAVING count(*) FILTER (WHERE label = 'correct') < 15"))
