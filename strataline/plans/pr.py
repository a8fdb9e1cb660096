"""Projections, filters and predicates over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataline.functions import labels as L
from strataline.operators import temporal as T
from strataline.sources import views as V
from strataline.sources.views import FACTS, LOG, TURNS, oracle

QUERIES: dict = {}
ORACLE_SQL: dict = {}
D = "DATE '2024-01-15'"


def _at():
    return F.lit("2024-01-15").cast("date")


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _ids(rows):
    return rows.select("fact_id")


_add("pr01_open_interval", lambda s, d: _ids(V.facts(s, d).where(T.holds_at(F.col("start"), F.col("end"), _at()))),
     oracle(FACTS, body=f'SELECT fact_id FROM facts WHERE (start IS NULL OR start <= {D}) AND ("end" IS NULL OR "end" >= {D})'))


def pr02(s, d):
    g = V.facts(s, d).groupBy("subject", "property", "object").agg(F.collect_set("start").alias("starts"), F.collect_set("end").alias("ends"))
    return g.where(T.holds_since_start(F.col("starts"), F.col("ends"), _at())).select("subject", "property", "object")


_add("pr02_start_required", pr02, oracle(FACTS, body=f'SELECT subject, property, object FROM facts GROUP BY 1, 2, 3 HAVING min(start) <= {D} AND (max("end") IS NULL OR max("end") >= {D})'))
_add("pr03_current_claim", lambda s, d: _ids(V.facts(s, d).where(T.current_claim(F.nullif(F.col("start"), F.lit("2024-01-05").cast("date")), F.col("end"), F.col("rank"), _at()))),
     oracle(FACTS, body=f"""SELECT fact_id FROM (SELECT *, nullif(start, DATE '2024-01-05') AS st FROM facts) WHERE (st IS NOT NULL OR "end" IS NOT NULL OR rank = 'preferred') AND (st IS NULL OR st <= {D}) AND ("end" IS NULL OR "end" >= {D})"""))
_add("pr04_preferred_rank", lambda s, d: _ids(T.preferred_rank(V.facts(s, d), ["subject", "property"])),
     oracle(FACTS, body="SELECT fact_id FROM (SELECT *, max(CASE WHEN rank = 'preferred' THEN 1 ELSE 0 END) OVER (PARTITION BY subject, property) AS p FROM facts WHERE rank <> 'deprecated') WHERE p = 0 OR rank = 'preferred'"))
_add("pr05_boundary_window", lambda s, d: _ids(V.facts(s, d).where(T.in_window(F.col("start"), F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date")))),
     oracle(FACTS, body="SELECT fact_id FROM facts WHERE start > DATE '2024-01-10' AND start <= DATE '2024-01-12'"))
_add("pr06_is_current", lambda s, d: _ids(V.facts(s, d).where(F.col("end").isNull())), oracle(FACTS, body='SELECT fact_id FROM facts WHERE "end" IS NULL'))
_add("pr07_stable_claim", lambda s, d: V.table(s, d, "orders").where(T.stable_claim(F.to_date("o_orderdate"), F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")), F.lit("2001-08-01").cast("date"), 3)).select("o_orderkey"),
     "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') >= 1095")


def pr08(s, d):
    p = V.table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 == 0, None).otherwise(F.col("p_size") - 1).cast("long").alias("views"))
    return p.alias("a").join(p.alias("b"), F.expr("b.p_partkey = a.p_partkey + 1")).where(L.similar_popularity(F.col("a.views"), F.col("b.views"), 30)).select(F.col("a.p_partkey").alias("left_key"), F.col("b.p_partkey").alias("right_key"))


_add("pr08_similar_popularity", pr08, """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size - 1 END AS v FROM part)
SELECT a.p_partkey AS left_key, b.p_partkey AS right_key FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1
WHERE a.v IS NULL OR b.v IS NULL OR (a.v = 0 AND b.v = 0) OR abs(a.v - b.v) * 100 <= 30 * greatest(a.v, b.v)""")
_add("pr09_specific_office", lambda s, d: V.table(s, d, "part").where("p_name is not null and not p_name rlike '(?i)^(the|a) ' and p_type rlike '[A-Z]'").join(V.table(s, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey"),
     "SELECT p_partkey FROM part WHERE p_name IS NOT NULL AND NOT regexp_matches(p_name, '(?i)^(the|a) ') AND regexp_matches(p_type, '[A-Z]') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")


def pr10(s, d):
    log = V.log(s, d).where("contract_hash = 'c1'")
    done = log.where("slot = 'gate' and label = 'correct'").select("case_id", "model").distinct()
    return log.join(done, ["case_id", "model"], "left_semi").select("line_no")


_add("pr10_completed_attempts", pr10, oracle(LOG, body="SELECT line_no FROM log l WHERE contract_hash = 'c1' AND EXISTS (SELECT 1 FROM log g WHERE g.contract_hash = 'c1' AND g.slot = 'gate' AND g.label = 'correct' AND g.case_id = l.case_id AND g.model = l.model)"))
_add("pr11_latest_contract", lambda s, d: V.log(s, d).groupBy("model").agg(F.max_by("contract_hash", F.when(F.col("contract_hash").isNotNull(), F.col("line_no"))).alias("contract_hash")),
     oracle(LOG, body="SELECT model, arg_max(contract_hash, line_no) AS contract_hash FROM log GROUP BY 1"))
_add("pr12_public_fields", lambda s, d: L.public_fields(V.log(s, d), ["line_no", "slot", "model"], ["value"]), oracle(LOG, body="SELECT line_no, slot, model FROM log"))
_add("pr13_leak_scan", lambda s, d: L.leaks(V.table(s, d, "documents"), V.table(s, d, "benchmark"), "doc_id", "text", "item_id", "text"),
     "SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(lower(d.text), lower(b.text))")
_add("pr14_failure_mode", lambda s, d: V.log(s, d).select("line_no", L.failure_mode(F.col("label"), F.col("k") % 3 == 0, F.col("distance").isNull(), F.col("value") > 50).alias("mode")),
     oracle(LOG, body="SELECT line_no, CASE WHEN label = 'stick_new' AND value > 50 THEN 'success' WHEN label = 'stick_new' THEN 'right_without_evidence' WHEN k % 3 = 0 THEN 'not_submitted' WHEN distance IS NULL THEN 'target_not_reached' WHEN label = 'stick_old' THEN 'prior_reversion' WHEN label = 'correct' THEN 'partial' ELSE 'wrong_answer' END AS mode FROM log"))
_add("pr15_trajectory_outcome", lambda s, d: V.turns(s, d).groupBy("attempt").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "system").alias("n_system"), F.count_if(F.col("action") == "assistant").alias("n_reply")).select("attempt", F.when(F.col("n_reply") == 0, "no_reply").when(F.col("n_system") == 0, "no_gate").when(F.col("n") < 4, "short").otherwise("complete").alias("outcome")),
     oracle(TURNS, body="SELECT attempt, CASE WHEN count(*) FILTER (WHERE action = 'assistant') = 0 THEN 'no_reply' WHEN count(*) FILTER (WHERE action = 'system') = 0 THEN 'no_gate' WHEN count(*) < 4 THEN 'short' ELSE 'complete' END AS outcome FROM turns GROUP BY 1"))


def pr16(s, d):
    g = V.log(s, d).groupBy("case_id").agg(F.count("*").alias("sampled"), F.count_if(F.col("slot") == "gate").alias("checked"), F.count_if((F.col("slot") == "gate") & (F.col("label") == "correct")).alias("supported"))
    return g.select("case_id", L.recommendation(F.col("sampled"), F.col("checked"), F.col("supported"), 40, 10, 4, 0.3).alias("advice"))


_add("pr16_recommendation", pr16, oracle(LOG, body="""SELECT case_id, CASE WHEN n = 0 THEN 'no_samples' WHEN n < 40 THEN 'few_samples' WHEN c = 0 THEN 'unchecked' WHEN c < 10 THEN 'few_checks' WHEN s = 0 THEN 'unsupported' WHEN s < 4 THEN 'few_supported' WHEN s * 1.0 / c < 0.3 THEN 'low_rate' ELSE 'admit' END AS advice
FROM (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE slot = 'gate') AS c, count(*) FILTER (WHERE slot = 'gate' AND label = 'correct') AS s FROM log GROUP BY 1)"""))
_add("pr17_keyword_label", lambda s, d: V.turns(s, d).select("attempt", "step", L.keyword_label(F.col("text"), ["the of", "der"], ["la ", "ing"], ["maybe", "is"]).alias("label")),
     oracle(TURNS, body="SELECT attempt, step, CASE WHEN contains(lower(text), 'la ') OR contains(lower(text), 'ing') THEN 'stick_new' WHEN contains(lower(text), 'the of') OR contains(lower(text), 'der') THEN 'stick_old' WHEN contains(lower(text), 'maybe') OR contains(lower(text), 'is') THEN 'hedge' ELSE 'other' END AS label FROM turns"))


def pr18(s, d):
    new = V.table(s, d, "labels").select(F.col("doc_id").alias("case_id"), F.when(F.col("toxic") == 1, "flagged").alias("new_label"))
    return V.log(s, d).where("slot = 'pk'").join(new.dropDuplicates(["case_id"]), "case_id", "left").select("line_no", F.coalesce("new_label", "label").alias("label"))


_add("pr18_relabel", pr18, oracle(LOG, body="SELECT line_no, coalesce(CASE WHEN toxic = 1 THEN 'flagged' END, label) AS label FROM log LEFT JOIN labels ON doc_id = case_id WHERE slot = 'pk'"))


def pr19(s, d):
    w = Window.partitionBy("case_id", "model").orderBy("line_no")
    return V.log(s, d).select("line_no", L.transition_label(F.lag("label").over(w), F.col("label")).alias("transition"))


_add("pr19_transition_label", pr19, oracle(LOG, body="""SELECT line_no, CASE WHEN p IS NULL THEN 'initial' WHEN p = 'stick_new' AND label = 'stick_old' THEN 'reversion' WHEN p = 'stick_old' AND label = 'stick_new' THEN 'recovery' WHEN p = label THEN 'stable_' || label ELSE p || '_to_' || label END AS transition
FROM (SELECT *, lag(label) OVER (PARTITION BY case_id, model ORDER BY line_no) AS p FROM log)"""))
_add("pr20_infrastructure_error", lambda s, d: V.turns(s, d).groupBy("attempt").agg(F.collect_list("text").alias("errors")).select("attempt", L.has_marker(F.col("errors"), ["timeout", "the the", "429"]).alias("infrastructure")),
     oracle(TURNS, body="SELECT attempt, bool_or(contains(lower(text), 'timeout') OR contains(lower(text), 'the the') OR contains(lower(text), '429')) AS infrastructure FROM turns GROUP BY 1"))
_add("pr21_authorisation", lambda s, d: V.log(s, d).groupBy("case_id").agg(F.bool_or(F.expr("slot = 'gate' and label = 'correct'")).alias("api"), F.bool_or(F.expr("slot = 'pk' and label = 'correct'")).alias("open"), F.count_if(F.col("label") == "correct").alias("admitted")).select("case_id", L.authorisation(F.col("api"), F.col("open"), F.col("admitted"), 3).alias("reasons")).select("case_id", (F.size("reasons") == 0).alias("allowed"), F.array_join("reasons", ",").alias("reasons")),
     oracle(LOG, body="""SELECT case_id, api AND open_ AND n >= 3 AS allowed, concat_ws(',', CASE WHEN NOT api THEN 'controller_gate' END, CASE WHEN NOT open_ THEN 'method_gate' END, CASE WHEN n < 3 THEN 'admitted_cases' END) AS reasons
FROM (SELECT case_id, bool_or(slot = 'gate' AND label = 'correct') AS api, bool_or(slot = 'pk' AND label = 'correct') AS open_, count(*) FILTER (WHERE label = 'correct') AS n FROM log GROUP BY 1)"""))  # fmt: skip
_add("pr22_needs_review", lambda s, d: V.table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").isin("P", "O").alias("needs_review")), "SELECT o_orderkey, o_orderstatus IN ('P', 'O') AS needs_review FROM orders")


def pr23(s, d):
    have = V.log(s, d).where("label = 'correct'").groupBy("case_id").agg(F.collect_set("model").alias("admitted"))
    need = F.array(F.lit("click"), F.lit("view"))
    return have.select("case_id", (F.size(F.array_except(need, "admitted")) == 0).alias("capable"), F.array_join(F.array_sort(F.array_except(need, "admitted")), ",").alias("missing"))


_add("pr23_capability", pr23, oracle(LOG, body="SELECT case_id, bool_or(model = 'click') AND bool_or(model = 'view') AS capable, concat_ws(',', CASE WHEN NOT bool_or(model = 'click') THEN 'click' END, CASE WHEN NOT bool_or(model = 'view') THEN 'view' END) AS missing FROM log WHERE label = 'correct' GROUP BY 1"))


def pr24(s, d):
    g = V.revisions(s, d).groupBy("page").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    dates = F.array_sort(F.array_distinct(F.array_compact(F.array("a", F.when(F.col("page") % 3 == 0, F.date_add("a", 30)), "b"))))
    return g.select("page", F.array_join(F.transform(dates, lambda x: x.cast("string")), ",").alias("dates"), (F.size(dates) >= 2).alias("valid"))


_add("pr24_snapshot_dates", pr24, oracle(V.REVISIONS, "g AS (SELECT page, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM revisions GROUP BY 1)", "x AS (SELECT page, a AS t FROM g UNION SELECT page, a + 30 FROM g WHERE page % 3 = 0 UNION SELECT page, b FROM g)", body="SELECT page, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS dates, count(*) >= 2 AS valid FROM x GROUP BY 1"))
_add("pr25_public_case", lambda s, d: V.facts(s, d).select("fact_id", (F.col("start").isNotNull() & F.coalesce(F.col("start") < F.col("end"), F.lit(True)) & (F.col("rank") != "deprecated")).alias("valid")),
     oracle(FACTS, body="SELECT fact_id, start IS NOT NULL AND coalesce(start < \"end\", true) AND rank <> 'deprecated' AS valid FROM facts"))


def pr26(s, d):
    hops = V.turns(s, d).groupBy("attempt").agg(F.array_sort(F.collect_list(F.struct("step", "action"))).alias("hops"))
    acts = F.flatten(F.transform("hops", lambda h: F.when(h.action == "user", F.array(F.concat(F.lit("switch:"), h.step.cast("string")), F.concat(F.lit("follow:"), h.step.cast("string")))).otherwise(F.array(F.concat(F.lit("read:"), h.step.cast("string"))))))
    return hops.select("attempt", F.posexplode(acts).alias("pos", "route_action")).withColumn("pos", F.col("pos").cast("long"))


_add("pr26_route_actions", pr26, oracle(TURNS, """x AS (SELECT attempt, step, 0 AS o, CASE WHEN action = 'user' THEN 'switch:' ELSE 'read:' END || CAST(step AS VARCHAR) AS a FROM turns UNION ALL SELECT attempt, step, 1, 'follow:' || CAST(step AS VARCHAR) FROM turns WHERE action = 'user')""",
     body="SELECT attempt, row_number() OVER (PARTITION BY attempt ORDER BY step, o) - 1 AS pos, a AS route_action FROM x"))


def pr27(s, d):
    g = V.facts(s, d).groupBy("subject").agg(F.count("*").alias("n"), F.count_if(F.col("rank") == "preferred").alias("p"), F.max("start").alias("last"))
    reasons = F.array_compact(F.array(F.when(F.col("n") < 60, "few_facts"), F.when(F.col("p") < 5, "few_preferred")))
    return g.select("subject", F.when(F.size(reasons) == 0, "ready").otherwise("rejected").alias("status"), F.array_join(reasons, ";").alias("reasons"), "last")


_add("pr27_case_packets", pr27, oracle(FACTS, body="""SELECT subject, CASE WHEN n >= 60 AND p >= 5 THEN 'ready' ELSE 'rejected' END AS status, concat_ws(';', CASE WHEN n < 60 THEN 'few_facts' END, CASE WHEN p < 5 THEN 'few_preferred' END) AS reasons, last
FROM (SELECT subject, count(*) AS n, count(*) FILTER (WHERE rank = 'preferred') AS p, max(start) AS last FROM facts GROUP BY 1)"""))
