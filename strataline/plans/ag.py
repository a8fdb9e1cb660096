"""Aggregations over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataline.operators import analytics as A
from strataline.sources import views as V
from strataline.sources.views import FACTS, LINKS, LOG, TURNS, oracle

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _correct():
    return F.when(F.col("arm") == "conflict", F.col("label") == "stick_new").otherwise(F.col("label") == "correct")


OK_SQL = "(CASE WHEN arm = 'conflict' THEN label = 'stick_new' ELSE label = 'correct' END)"
CELLS = f"cell AS (SELECT model, arm, distance, occurrence, count(*) FILTER (WHERE {OK_SQL}) AS successes, count(*) AS n FROM log WHERE slot IN ('ripple', 'control') GROUP BY 1, 2, 3, 4)"


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def cells(s, d):
    return A.cells(V.log(s, d).where("slot in ('ripple', 'control')"), ["model", "arm", "distance", "occurrence"], _correct())


def per_case(s, d, **aggs):
    return V.log(s, d).groupBy("model", "case_id").agg(*(F.expr(e).alias(n) for n, e in aggs.items()))


def per_case_sql(**aggs):
    parts = ", ".join(f"{e} AS {n}" for n, e in aggs.items())
    return oracle(LOG, body=f"SELECT model, case_id, {parts} FROM log GROUP BY 1, 2")


_add("ag01_accuracy_cells", cells, oracle(LOG, CELLS, body="SELECT * FROM cell"))
_add("ag02_correct_counts", lambda s, d: V.log(s, d).groupBy("arm").agg(F.sum(_correct().cast("long")).alias("s"), F.count("*").alias("n"), (F.count_if(F.lit(False)) == 0).alias("empty_is_null")),
     oracle(LOG, body=f"SELECT arm, count(*) FILTER (WHERE {OK_SQL}) AS s, count(*) AS n, true AS empty_is_null FROM log GROUP BY 1"))
_add("ag03_pk_counts", lambda s, d: V.log(s, d).where("slot = 'pk'").groupBy("model", "case_id").agg(F.count_if(F.col("label") == "stick_old").alias("stick_old"), F.count("*").alias("n")),
     oracle(LOG, body="SELECT model, case_id, count(*) FILTER (WHERE label = 'stick_old') AS stick_old, count(*) AS n FROM log WHERE slot = 'pk' GROUP BY 1, 2"))


def ag04(s, d):
    g = V.log(s, d).groupBy("model", "case_id").agg(F.collect_list(F.when(F.col("label") == "correct", F.col("distance"))).alias("seen"))
    total = g.groupBy("model").agg(F.count("*").alias("hits"), F.count_if(F.size("seen") > 0).alias("with_seen"))
    by = g.select("model", F.explode("seen").alias("x")).groupBy("model").pivot("x", [0, 1, 2, 3]).count().select("model", *(F.coalesce(str(k), F.lit(0)).alias(f"d{k}") for k in range(4)))
    return total.join(by, "model", "left")


_add("ag04_pre_seen", ag04, oracle(LOG, body="SELECT model, count(DISTINCT case_id) AS hits, count(DISTINCT case_id) FILTER (WHERE label = 'correct' AND distance IS NOT NULL) AS with_seen, count(*) FILTER (WHERE label = 'correct' AND distance = 0) AS d0, count(*) FILTER (WHERE label = 'correct' AND distance = 1) AS d1, count(*) FILTER (WHERE label = 'correct' AND distance = 2) AS d2, count(*) FILTER (WHERE label = 'correct' AND distance = 3) AS d3 FROM log GROUP BY 1"))
_add("ag05_bootstrap", lambda s, d: A.bootstrap(cells(s, d), ["model", "arm", "distance", "occurrence"]))


def paired(s, d):
    c = cells(s, d)
    a = c.where("arm = 'conflict'").select("model", "distance", "occurrence", F.col("successes").alias("a_successes"), F.col("n").alias("a_n"))
    b = c.where("arm = 'control'").select("model", "distance", "occurrence", F.col("successes").alias("b_successes"), F.col("n").alias("b_n"))
    return a.join(b, ["model", "distance", "occurrence"])


_add("ag06_bootstrap_difference", lambda s, d: A.bootstrap_difference(paired(s, d), ["model", "distance", "occurrence"]))
_add("ag07_bootstrap_resampling", lambda s, d: A.bootstrap_difference(paired(s, d).groupBy("model").agg(*(F.sum(c).alias(c) for c in ("a_successes", "a_n", "b_successes", "b_n"))), ["model"], seed=7))
_add("ag08_half_life", lambda s, d: A.half_life(cells(s, d).where("arm = 'conflict'"), ["model", "distance"]),
     oracle(LOG, CELLS, body="SELECT model, distance, coalesce(CAST(min(occurrence) FILTER (WHERE 2 * successes < n) AS VARCHAR), '>' || CAST(max(occurrence) AS VARCHAR)) AS half_life FROM cell WHERE arm = 'conflict' GROUP BY 1, 2"))
_add("ag09_radius", lambda s, d: A.radius(cells(s, d), ["model", "arm"], 3, 20).withColumn("radius", F.col("radius").cast("long")),
     oracle(LOG, CELLS, body="SELECT model, arm, coalesce(max(distance) FILTER (WHERE occurrence = 3 AND 100 * successes >= 20 * n), 0) AS radius FROM cell GROUP BY 1, 2"))


def transitions(s, d):
    log = V.log(s, d).where("distance is not null").withColumn("ok", _correct())
    return A.paired_transitions(log, ["case_id", "model", "distance"], "occurrence", "ok", "line_no")


TRANS = f"""occ AS (SELECT case_id, model, distance, occurrence, arg_max({OK_SQL}, line_no) AS c FROM log WHERE distance IS NOT NULL GROUP BY 1, 2, 3, 4),
nx AS (SELECT *, lead(c) OVER (PARTITION BY case_id, model, distance ORDER BY occurrence) AS n FROM occ),
tr AS (SELECT case_id, model, distance, CASE WHEN c AND n THEN 'stable_correct' WHEN c THEN 'reversion' WHEN n THEN 'recovery' ELSE 'stable_wrong' END AS kind FROM nx WHERE n IS NOT NULL)"""
KINDS = ["stable_correct", "reversion", "recovery", "stable_wrong"]
_add("ag10_transitions", lambda s, d: transitions(s, d).groupBy("model").pivot("kind", KINDS).count(),
     oracle(LOG, TRANS, body="SELECT model, " + ", ".join(f"nullif(count(*) FILTER (WHERE kind = '{k}'), 0) AS {k}" for k in KINDS) + " FROM tr GROUP BY 1"))
_add("ag11_mcnemar", lambda s, d: transitions(s, d).groupBy("model", "distance").agg(F.count_if(F.col("kind") == "reversion").alias("b"), F.count_if(F.col("kind") == "recovery").alias("c")).select("model", "distance", "b", "c", F.round(A.mcnemar(F.col("b"), F.col("c")), 6).alias("p")),
     oracle(LOG, TRANS, "g AS (SELECT model, distance, count(*) FILTER (WHERE kind = 'reversion') AS b, count(*) FILTER (WHERE kind = 'recovery') AS c FROM tr GROUP BY 1, 2)",
            "t AS (SELECT *, unnest(range(0, b + c + 1)) AS i FROM g)", "m AS (SELECT *, exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0)) AS pmf, exp(lgamma(b + c + 1) - lgamma(b + 1) - lgamma(c + 1) - (b + c) * ln(2.0)) AS own FROM t)",
            body="SELECT model, distance, b, c, CASE WHEN b + c > 0 THEN round(least(1.0, sum(pmf) FILTER (WHERE pmf <= own * (1 + 1e-9) + 1e-12)), 6) END AS p FROM m GROUP BY model, distance, b, c"))
_add("ag12_gate_attrition", lambda s, d: V.log(s, d).groupBy("model", "arm", "slot", "distance").agg(F.count("*").alias("attempts"), F.count_if(F.col("k") > 30).alias("hits"), F.count_if((F.col("k") > 30) & (F.col("label") == "correct")).alias("eligible")),
     oracle(LOG, body="SELECT model, arm, slot, distance, count(*) AS attempts, count(*) FILTER (WHERE k > 30) AS hits, count(*) FILTER (WHERE k > 30 AND label = 'correct') AS eligible FROM log GROUP BY 1, 2, 3, 4"))
_add("ag13_transition_pivot", lambda s, d: transitions(s, d).groupBy("model", "distance").pivot("kind").count().na.fill(0),
     oracle(LOG, TRANS, body="SELECT model, distance, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in KINDS) + " FROM tr GROUP BY 1, 2"))


def ag14(s, d):
    log = V.log(s, d)
    hist = log.where("slot = 'gate'").groupBy("model", "label").count().groupBy("model").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "count"))))).alias("failures"))
    main = log.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "correct").alias("correct"), F.count_if(F.col("slot") == "gate").alias("gates"), F.count_if(F.col("distance").isNull()).alias("no_distance"), F.sum(F.when(F.col("label") == "correct", F.col("k"))).alias("detour_sum"))
    return main.join(hist, "model", "left")


_add("ag14_score_rollup", ag14, oracle(LOG, "h AS (SELECT model, '{' || string_agg('\"' || label || '\":' || CAST(c AS VARCHAR), ',' ORDER BY label) || '}' AS failures FROM (SELECT model, label, count(*) AS c FROM log WHERE slot = 'gate' GROUP BY 1, 2) GROUP BY 1)",
     body="SELECT model, count(*) AS n, count(*) FILTER (WHERE label = 'correct') AS correct, count(*) FILTER (WHERE slot = 'gate') AS gates, count(*) FILTER (WHERE distance IS NULL) AS no_distance, CAST(sum(k) FILTER (WHERE label = 'correct') AS BIGINT) AS detour_sum, any_value(failures) AS failures FROM log LEFT JOIN h USING (model) GROUP BY 1"))


def ag15(s, d):
    x = V.log(s, d).withColumn("answer", F.when(F.col("k") % 6 == 0, F.lit("  ")).otherwise(F.col("label"))).withColumn("final", F.when(F.trim("answer") == "", "no_answer").otherwise(F.col("label")))
    return x.groupBy("model").agg(F.count_if(F.col("final") == "no_answer").alias("no_answer"), F.count_if(F.col("final") != F.col("label")).alias("disagree"))


_add("ag15_blank_answers", ag15, oracle(LOG, body="SELECT model, count(*) FILTER (WHERE k % 6 = 0) AS no_answer, count(*) FILTER (WHERE k % 6 = 0) AS disagree FROM log GROUP BY 1"))
_add("ag16_factorised_admission", lambda s, d: A.admission(V.log(s, d).where("slot = 'pk'"), ["model", "case_id"], "repeat", F.col("label") == "stick_new", F.col("k") != 13, F.col("repeat") < 2, 0.5),
     oracle(LOG, "e AS (SELECT model, case_id, repeat, count(*) FILTER (WHERE label = 'stick_new') AS known, count(*) AS n, bool_and(k <> 13) AS ok FROM log WHERE slot = 'pk' GROUP BY 1, 2, 3)", body="SELECT model, case_id, bool_and(ok AND (repeat >= 2 OR known <= 0.5 * n)) AS admitted, count(*) AS probes, CAST(sum(known) AS BIGINT) AS known FROM e GROUP BY 1, 2"))
_add("ag17_single_probe_admission", lambda s, d: per_case(s, d, ok="count_if(label = 'stick_new') * 4 <= count(*) or count_if(label = 'stick_old') * 5 >= 4 * count(*)"), per_case_sql(ok="count(*) FILTER (WHERE label = 'stick_new') * 4 <= count(*) OR count(*) FILTER (WHERE label = 'stick_old') * 5 >= 4 * count(*)"))
_add("ag18_relation_profile", lambda s, d: V.facts(s, d).groupBy("property").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("sources"), F.countDistinct("object").alias("targets"), F.count("end").alias("with_end"), F.count_if(F.col("rank") == "preferred").alias("preferred"), F.count_if(F.col("start").isNotNull() & F.col("end").isNotNull()).alias("complete")),
     oracle(FACTS, body="""SELECT property, count(*) AS n, count(DISTINCT subject) AS sources, count(DISTINCT object) AS targets, count("end") AS with_end, count(*) FILTER (WHERE rank = 'preferred') AS preferred, count(*) FILTER (WHERE start IS NOT NULL AND "end" IS NOT NULL) AS complete FROM facts GROUP BY 1"""))
_add("ag19_support_rate", lambda s, d: V.log(s, d).groupBy("arm").agg(F.try_divide(F.count_if(_correct() & F.col("slot").isin("ripple", "pk")), F.count_if(F.col("slot").isin("ripple", "pk"))).alias("rate"), F.count_if(_correct()).alias("supported")),
     oracle(LOG, body=f"SELECT arm, CAST(count(*) FILTER (WHERE {OK_SQL} AND slot IN ('ripple', 'pk')) AS DOUBLE) / nullif(count(*) FILTER (WHERE slot IN ('ripple', 'pk')), 0) AS rate, count(*) FILTER (WHERE {OK_SQL}) AS supported FROM log GROUP BY 1"))


def ag20(s, d):
    g = V.log(s, d).groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "correct").alias("passed"), F.sum("occurrence").alias("hops"), F.countDistinct("model").alias("families"))
    least = F.min("n").over(Window.partitionBy(F.lit(1)))
    return g.withColumn("conclusive", least >= 20)


_add("ag20_source_comparison", ag20, oracle(LOG, "g AS (SELECT arm, count(*) AS n, count(*) FILTER (WHERE label = 'correct') AS passed, CAST(sum(occurrence) AS BIGINT) AS hops, count(DISTINCT model) AS families FROM log GROUP BY 1)", body="SELECT *, (SELECT bool_and(n >= 20) FROM g) AS conclusive FROM g"))
_add("ag21_grouping_counts", lambda s, d: A.grouping_counts(V.log(s, d), ["slot", "model", "arm", "label"]),
     oracle(LOG, body=" UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM log GROUP BY {c}" for c in ("slot", "model", "arm", "label"))))
_add("ag22_primary_metrics", lambda s, d: V.log(s, d).agg(F.count("*").alias("n"), *(F.count_if(F.expr(e)).alias(a) for a, e in (("m1", "label = 'correct'"), ("m2", "k > 50"), ("m3", "distance is null"), ("m4", "arm = 'conflict'"))), F.max(F.when(F.col("distance").isNull() & (F.col("label") == "correct"), F.col("k"))).alias("m5")),
     oracle(LOG, body="SELECT count(*) AS n, count(*) FILTER (WHERE label = 'correct') AS m1, count(*) FILTER (WHERE k > 50) AS m2, count(*) FILTER (WHERE distance IS NULL) AS m3, count(*) FILTER (WHERE arm = 'conflict') AS m4, max(k) FILTER (WHERE distance IS NULL AND label = 'correct') AS m5 FROM log"))


def ag23(s, d):
    runs = V.log(s, d).groupBy("model", "case_id", "repeat").agg(F.bool_or(F.expr("label = 'correct'")).alias("any_correct"), F.bool_or(F.expr("k > 90")).alias("any_bridge"))
    methods = s.createDataFrame([(m,) for m in ("click", "view", "absent")], "model string")
    g = runs.groupBy("model").agg(F.count_if("any_correct").alias("correct"), F.count_if("any_bridge").alias("bridge"), F.count("*").alias("runs"))
    return methods.join(g, "model", "left").select("model", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("correct", "bridge", "runs")))


_add("ag23_method_aggregate", ag23, oracle(LOG, "r AS (SELECT model, case_id, repeat, bool_or(label = 'correct') AS a, bool_or(k > 90) AS b FROM log GROUP BY 1, 2, 3)", "m AS (SELECT * FROM (VALUES ('click'), ('view'), ('absent')) v(model))", body="SELECT m.model, count(*) FILTER (WHERE a) AS correct, count(*) FILTER (WHERE b) AS bridge, count(r.model) AS runs FROM m LEFT JOIN r USING (model) GROUP BY 1"))
_add("ag24_any_flags", lambda s, d: per_case(s, d, bridge="bool_or(k > 60)", tail="bool_or(k > 80)", complete="bool_or(k > 80 and label = 'correct')"), per_case_sql(bridge="bool_or(k > 60)", tail="bool_or(k > 80)", complete="bool_or(k > 80 AND label = 'correct')"))


def ag25(s, d):
    w = Window.partitionBy("model", "case_id").orderBy(F.desc("k"), "line_no")
    r = V.log(s, d).withColumn("r", F.row_number().over(w)).groupBy("model", "case_id").agg(F.min(F.when(F.col("label") == "correct", F.col("r"))).alias("best"), F.max(F.when(F.col("label") == "correct", F.col("k"))).alias("p"), F.max(F.when(F.col("label") == "other", F.col("k"))).alias("q"))
    return r.groupBy("model").agg(F.count_if(F.col("best") <= 3).alias("recall3"), F.min("best").cast("long").alias("best_rank"), F.count_if(F.col("p") > F.col("q")).alias("separated"), F.count("*").alias("n"))


_add("ag25_gate_recall", ag25, oracle(LOG, "x AS (SELECT *, row_number() OVER (PARTITION BY model, case_id ORDER BY k DESC, line_no) AS r FROM log)", "y AS (SELECT model, case_id, min(r) FILTER (WHERE label = 'correct') AS best, max(k) FILTER (WHERE label = 'correct') AS p, max(k) FILTER (WHERE label = 'other') AS q FROM x GROUP BY 1, 2)", body="SELECT model, count(*) FILTER (WHERE best <= 3) AS recall3, min(best) AS best_rank, count(*) FILTER (WHERE p > q) AS separated, count(*) AS n FROM y GROUP BY 1"))
_add("ag26_capabilities", lambda s, d: per_case(s, d, attempts="count(*)", good="count_if(label = 'correct')", pages="count(distinct k)", versions="count(distinct k, arm)", seen="bool_or(distance = 3)"), per_case_sql(attempts="count(*)", good="count(*) FILTER (WHERE label = 'correct')", pages="count(DISTINCT k)", versions="count(DISTINCT (k, arm))", seen="bool_or(distance = 3)"))
_add("ag27_engineering", lambda s, d: V.log(s, d).groupBy("model", "case_id").agg(F.count_if(F.col("slot") == "pk").alias("a"), F.bool_and(F.when(F.col("slot") == "pk", F.col("k") < 90)).alias("v"), (F.count("*") - F.countDistinct("k")).alias("repeats")).select("model", "case_id", F.when(F.col("a") == 0, "not_attempted").otherwise(F.col("v").cast("string")).alias("validity"), "repeats"),
     oracle(LOG, body="SELECT model, case_id, CASE WHEN count(*) FILTER (WHERE slot = 'pk') = 0 THEN 'not_attempted' ELSE CAST(bool_and(k < 90) FILTER (WHERE slot = 'pk') AS VARCHAR) END AS validity, count(*) - count(DISTINCT k) AS repeats FROM log GROUP BY 1, 2"))
_add("ag28_funnel", lambda s, d: V.log(s, d).groupBy("model").agg(F.count("*").alias("legal"), F.count_if(F.col("k") > 20).alias("scored"), F.count_if(F.col("k") > 95).alias("expanded"), F.count_if(F.col("k") > 100).alias("reached")).withColumn("first_failing", F.when(F.col("scored") == 0, "scored").when(F.col("expanded") == 0, "expanded").when(F.col("reached") == 0, "reached").otherwise("none")),
     oracle(LOG, body="SELECT model, count(*) AS legal, count(*) FILTER (WHERE k > 20) AS scored, count(*) FILTER (WHERE k > 95) AS expanded, count(*) FILTER (WHERE k > 100) AS reached, CASE WHEN count(*) FILTER (WHERE k > 20) = 0 THEN 'scored' WHEN count(*) FILTER (WHERE k > 95) = 0 THEN 'expanded' WHEN count(*) FILTER (WHERE k > 100) = 0 THEN 'reached' ELSE 'none' END AS first_failing FROM log GROUP BY 1"))
_add("ag29_validation_summary", lambda s, d: V.table(s, d, "orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).alias("pass_urgent")),
     "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS pass_urgent FROM orders")
_add("ag30_spine_groups", lambda s, d: V.log(s, d).groupBy("k", "arm").agg(F.min_by("line_no", F.struct((F.col("label") != "correct").alias("x"), "line_no")).alias("representative"), F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models")),
     oracle(LOG, body="SELECT k, arm, arg_min(line_no, (label <> 'correct', line_no)) AS representative, count(*) AS members, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM log GROUP BY 1, 2"))
_add("ag31_judge_agreement", lambda s, d: A.confusion(V.table(s, d, "labels"), "quality", "toxic"), "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")


def ag32(s, d):
    c = V.log(s, d).groupBy("model", "case_id").pivot("slot", ["control", "gate", "pk", "ripple"]).count().na.fill(0)
    return c.where("gate >= 3 and pk >= 3 and ripple >= 3").join(V.log(s, d).where("slot = 'gate' and label = 'correct'").select("model", "case_id").distinct(), ["model", "case_id"], "left_anti")


_add("ag32_backfill", ag32, oracle(LOG, "c AS (SELECT model, case_id, " + ", ".join(f"count(*) FILTER (WHERE slot = '{x}') AS {x}" for x in ("control", "gate", "pk", "ripple")) + " FROM log GROUP BY 1, 2)", body="SELECT * FROM c WHERE gate >= 3 AND pk >= 3 AND ripple >= 3 AND NOT EXISTS (SELECT 1 FROM log l WHERE slot = 'gate' AND label = 'correct' AND l.model = c.model AND l.case_id = c.case_id)"))
_add("ag33_completed_sets", lambda s, d: V.log(s, d).where("slot = 'gate'").select("model", "case_id", "repeat").distinct(), oracle(LOG, body="SELECT DISTINCT model, case_id, repeat FROM log WHERE slot = 'gate'"))


def ag34(s, d):
    l = V.links(s, d)
    i = l.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("in_degree"))
    return l.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("out_degree")).join(i, "node", "full").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


_add("ag34_degrees", ag34, oracle(LINKS, body="SELECT node, count(*) FILTER (WHERE o) AS out_degree, count(*) FILTER (WHERE NOT o) AS in_degree FROM (SELECT source AS node, true AS o FROM links UNION ALL SELECT target, false FROM links) GROUP BY 1"))
_add("ag35_facets", lambda s, d: V.log(s, d).agg(*(F.array_join(F.array_sort(F.collect_set(c)), "|").alias(c) for c in ("model", "arm", "slot", "label"))),
     oracle(LOG, body="SELECT " + ", ".join(f"string_agg(DISTINCT {c}, '|' ORDER BY {c}) AS {c}" for c in ("model", "arm", "slot", "label")) + " FROM log"))
_add("ag36_quota_capacity", lambda s, d: V.facts(s, d).groupBy("property").agg(F.countDistinct("object").alias("n")).agg(F.least(F.sum(F.least(F.lit(120), F.col("n") * 2)), F.lit(500)).alias("capacity")),
     oracle(FACTS, body="SELECT least(CAST(sum(least(120, n * 2)) AS BIGINT), 500) AS capacity FROM (SELECT property, count(DISTINCT object) AS n FROM facts GROUP BY 1)"))


def ag37(s, d):
    pop = V.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.count("*").alias("views")).where("views > 590")
    return V.links(s, d).select("target", "source").distinct().join(pop, "source", "left").groupBy("target").agg(F.coalesce(F.sum("views"), F.lit(0)).alias("score"), F.coalesce(F.max("views"), F.lit(0)).alias("best"))


_add("ag37_popularity", ag37, oracle(LINKS, "p AS (SELECT l_suppkey AS source, count(*) AS views FROM lineitem GROUP BY 1 HAVING count(*) > 590)", body="SELECT target, CAST(coalesce(sum(views), 0) AS BIGINT) AS score, coalesce(max(views), 0) AS best FROM links LEFT JOIN p USING (source) GROUP BY 1"))
_add("ag38_arm_scores", lambda s, d: V.log(s, d).groupBy("case_id", "arm").agg(F.bool_or(F.expr("k > 70")).alias("bridge"), F.bool_or(F.expr("slot = 'gate' and k > 70")).alias("tail"), F.bool_and(F.expr("k >= 0")).alias("valid")),
     oracle(LOG, body="SELECT case_id, arm, bool_or(k > 70) AS bridge, bool_or(slot = 'gate' AND k > 70) AS tail, bool_and(k >= 0) AS valid FROM log GROUP BY 1, 2"))
_add("ag39_replay_report", lambda s, d: V.turns(s, d).groupBy("action").agg(F.count("*").alias("steps"), F.countDistinct("attempt").alias("attempts"), F.count_if(F.length("text") > 200).alias("long_steps")),
     oracle(TURNS, body="SELECT action, count(*) AS steps, count(DISTINCT attempt) AS attempts, count(*) FILTER (WHERE length(text) > 200) AS long_steps FROM turns GROUP BY 1"))


def ag40(s, d):
    w = Window.partitionBy("case_id").orderBy("line_no")
    total = F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0))
    # every row adds to its case's meter; the gate's rows read it, and what was used between two readings is their difference
    read = V.log(s, d).select("case_id", "line_no", "slot", total.alias("total")).where("slot = 'gate'").drop("slot")
    return read.withColumn("delta", F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0)))


_add("ag40_usage_delta", ag40, oracle(LOG, "meter AS (SELECT case_id, line_no, slot, k, count(*) FILTER (WHERE slot = 'gate') OVER (PARTITION BY case_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) - CASE WHEN slot = 'gate' THEN 1 ELSE 0 END AS part FROM log)",
    "used AS (SELECT case_id, part, CAST(sum(k) AS BIGINT) AS delta, max(line_no) FILTER (WHERE slot = 'gate') AS line_no FROM meter GROUP BY 1, 2)",
    body="SELECT u.case_id, u.line_no, CAST((SELECT sum(k) FROM log l WHERE l.case_id = u.case_id AND l.line_no <= u.line_no) AS BIGINT) AS total, delta FROM used u WHERE u.line_no IS NOT NULL"))


def ag41(s, d):
    l = V.log(s, d)
    a, b = l.where("repeat = 0").select("model", "case_id", F.col("k").alias("x")), l.where("repeat = 1").select("model", "case_id", F.col("k").alias("y"))
    return a.join(b, ["model", "case_id"]).groupBy("model").agg(F.count("*").alias("n"), F.max(F.abs(F.col("x") - F.col("y"))).alias("worst"), F.count_if(F.col("x") == F.col("y")).alias("equal"))


_add("ag41_order_invariance", ag41, oracle(LOG, body="SELECT model, count(*) AS n, max(abs(a.k - b.k)) AS worst, count(*) FILTER (WHERE a.k = b.k) AS equal FROM log a JOIN log b USING (model, case_id) WHERE a.repeat = 0 AND b.repeat = 1 GROUP BY 1"))
