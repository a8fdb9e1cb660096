"""Window and ordered-sequence operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataline.operators import ordering as O
from strataline.operators import temporal as T
from strataline.sources import views as V
from strataline.sources.views import ANCHORS, FACTS, LOG, REVISIONS, TURNS, oracle

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _low():
    return F.lit("2024-01-03").cast("date")


def _high():
    return F.lit("2024-01-20").cast("date")


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def wn01(spark, d):
    return T.successor_transitions(V.facts(spark, d).where("property = 'purchase'"), "subject", "object", ["start", "fact_id"])


_add("wn01_successor_transitions", wn01, oracle(FACTS, body="""
SELECT subject, from_holder, to_holder, start, fact_id FROM (
  SELECT subject, lag(object) OVER w AS from_holder, object AS to_holder, start, fact_id FROM facts WHERE property = 'purchase' WINDOW w AS (PARTITION BY subject ORDER BY start, fact_id))
WHERE from_holder IS NOT NULL AND from_holder <> to_holder"""))  # fmt: skip


def wn02(spark, d):
    rows = V.facts(spark, d).where(T.in_window(F.col("start"), _low(), _high()))
    return T.first_unique(rows, ["subject", "property"], "start", "object")


_add("wn02_first_unique_event", wn02, oracle(FACTS, body="""
SELECT subject, property, start, min(object) AS object FROM (
  SELECT *, min(start) OVER (PARTITION BY subject, property) AS least FROM facts WHERE start > DATE '2024-01-03' AND start <= DATE '2024-01-20')
WHERE start = least GROUP BY 1, 2, 3 HAVING count(DISTINCT object) = 1"""))  # fmt: skip


def wn03(spark, d):
    f = V.facts(spark, d)
    before = T.latest_by(f.where("start <= date '2024-01-10'"), ["subject", "property"], "start", "object").select("subject", "property", F.col("object").alias("previous"))
    after = f.where("start > date '2024-01-10' and start <= date '2024-01-25'").join(before, ["subject", "property"])
    return T.next_unique(after, ["subject", "property"], "start", "object", "previous")


_add("wn03_next_unique_event", wn03, oracle(FACTS, """last AS (SELECT subject, property, start, min(object) AS previous FROM (SELECT *, max(start) OVER (PARTITION BY subject, property) AS m FROM facts WHERE start <= DATE '2024-01-10') WHERE start = m GROUP BY 1, 2, 3 HAVING count(DISTINCT object) = 1)""",
"""days AS (SELECT f.subject, f.property, l.previous, f.start, count(DISTINCT object) AS n, min(object) AS object FROM facts f JOIN last l ON f.subject = l.subject AND f.property = l.property WHERE f.start > DATE '2024-01-10' AND f.start <= DATE '2024-01-25' GROUP BY 1, 2, 3, 4)""",
"""walk AS (SELECT subject, property, previous, min(start) FILTER (WHERE n > 1) AS stop, min(start) FILTER (WHERE n = 1 AND object <> previous) AS start FROM days GROUP BY 1, 2, 3)""", body="""
SELECT w.subject, w.property, w.previous, w.start, d.object FROM walk w JOIN days d USING (subject, property, start) WHERE w.start IS NOT NULL AND (stop IS NULL OR w.start < stop)"""))  # fmt: skip


def wn04(spark, d):
    f = T.preferred_rank(V.facts(spark, d), ["subject", "property"])
    live = f.where(T.holds_at(F.col("start"), F.col("end"), F.lit("2024-01-15").cast("date")))
    policies = {"latest_start": T.latest_by(live, ["subject", "property"], "start", "object"), "latest_end": T.latest_by(live, ["subject", "property"], "end", "object"), "single": T.single_target(live, ["subject", "property"], "object").withColumn("start", F.lit(None).cast("date"))}
    out = None
    for name, rows in policies.items():
        part = rows.select("subject", "property", F.lit(name).alias("policy"), "object")
        out = part if out is None else out.unionByName(part)
    return out


_add("wn04_selection_policies", wn04, oracle(FACTS, """best AS (SELECT * FROM (SELECT *, max(CASE WHEN rank = 'preferred' THEN 1 ELSE 0 END) OVER (PARTITION BY subject, property) AS p FROM facts WHERE rank <> 'deprecated') WHERE p = 0 OR rank = 'preferred')""",
"""live AS (SELECT * FROM best WHERE (start IS NULL OR start <= DATE '2024-01-15') AND ("end" IS NULL OR "end" >= DATE '2024-01-15'))""", body="""
SELECT subject, property, 'latest_start' AS policy, min(object) AS object FROM (SELECT *, max(start) OVER (PARTITION BY subject, property) AS m FROM live) WHERE start = m GROUP BY 1, 2 HAVING count(DISTINCT object) = 1
UNION ALL SELECT subject, property, 'latest_end', min(object) FROM (SELECT *, max("end") OVER (PARTITION BY subject, property) AS m FROM live) WHERE "end" = m GROUP BY 1, 2 HAVING count(DISTINCT object) = 1
UNION ALL SELECT subject, property, 'single', min(object) FROM live GROUP BY 1, 2 HAVING count(DISTINCT object) = 1"""))  # fmt: skip


def wn05(spark, d):
    w = Window.partitionBy("case_id", "model", "distance").orderBy("occurrence", "line_no")
    rows = V.log(spark, d).where("slot = 'ripple'").select("case_id", "model", "distance", "occurrence", "line_no", F.lead("occurrence").over(w).alias("next_occurrence"))
    return rows.where("next_occurrence is not null").drop("line_no")


_add("wn05_occurrence_pairs", wn05, oracle(LOG, body="""
SELECT * FROM (SELECT case_id, model, distance, occurrence, lead(occurrence) OVER (PARTITION BY case_id, model, distance ORDER BY occurrence, line_no) AS next_occurrence FROM log WHERE slot = 'ripple') WHERE next_occurrence IS NOT NULL"""))  # fmt: skip

_add("wn06_first_wins", lambda s, d: O.first_wins(V.anchors(s, d).withColumn("folded", F.lower("target")), ["page_id", "folded"], ["pos"]).select("page_id", "folded", "pos", "target"),
     oracle(ANCHORS, body="SELECT page_id, lower(target) AS folded, min(pos) AS pos, arg_min(target, pos) AS target FROM anchors GROUP BY 1, 2"))
_add("wn07_last_wins", lambda s, d: O.last_wins(V.log(s, d), ["model", "case_id", "slot"], "line_no").select("model", "case_id", "slot", "line_no", "label", "k"),
     oracle(LOG, body="SELECT model, case_id, slot, max(line_no) AS line_no, arg_max(label, line_no) AS label, arg_max(k, line_no) AS k FROM log GROUP BY 1, 2, 3"))
_add("wn08_best_score", lambda s, d: O.best_score(V.log(s, d), ["model", "case_id"], F.col("k"), F.sha2(F.concat(F.lit("s|"), F.col("line_no").cast("string")), 256)).select("model", "case_id", "line_no", "k"),
     oracle(LOG, body="SELECT model, case_id, line_no, k FROM (SELECT *, row_number() OVER (PARTITION BY model, case_id ORDER BY k DESC, sha256('s|' || CAST(line_no AS VARCHAR))) AS rn FROM log) WHERE rn = 1"))


def wn09(spark, d):
    days = V.revisions(spark, d).select("page", F.to_date("ts").alias("day")).distinct()
    return O.even_sample(days, ["page"], "day", 4)


_add("wn09_even_sample", wn09, oracle(REVISIONS, """days AS (SELECT page, day, row_number() OVER (PARTITION BY page ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY page) AS n FROM (SELECT DISTINCT page, CAST(ts AS DATE) AS day FROM revisions))""",
"picks AS (SELECT DISTINCT page, CASE WHEN n <= 4 THEN k ELSE CAST(round_even(k * (n - 1) / 3.0, 0) AS BIGINT) END AS i FROM (SELECT DISTINCT page, n FROM days), range(4) t(k) WHERE n > 4 OR k < n)", body="SELECT page, day FROM days JOIN picks USING (page, i)"))
_add("wn10_round_robin", lambda s, d: O.round_robin(V.facts(s, d), "property", ["fact_id"], 60).select("fact_id", "property", "lap"),
     oracle(FACTS, body="SELECT fact_id, property, lap FROM (SELECT fact_id, property, row_number() OVER (PARTITION BY property ORDER BY fact_id) - 1 AS lap FROM facts) ORDER BY lap, property LIMIT 60"))


def wn11(spark, d):
    t = V.turns(spark, d)
    return t.groupBy("attempt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "action"))), lambda x: x.action), ">").alias("path"), F.max_by("action", "step").alias("last_action"))


_add("wn11_step_order", wn11, oracle(TURNS, body="SELECT attempt, string_agg(action, '>' ORDER BY step, action) AS path, arg_max(action, step) AS last_action FROM turns GROUP BY 1"))


def wn12(spark, d):
    w = Window.partitionBy("attempt", "action").orderBy("step")
    t = V.turns(spark, d).withColumn("revisit", F.row_number().over(w) > 1)
    return t.groupBy("attempt").agg(F.count_if("revisit").alias("revisits"), F.min(F.when(F.col("action") == "assistant", F.col("step"))).alias("first_hit"), (F.min(F.when(F.col("action") == "assistant", F.col("step"))) - 1).alias("detour"))


_add("wn12_revisits", wn12, oracle(TURNS, body="SELECT attempt, count(*) FILTER (WHERE rn > 1) AS revisits, min(step) FILTER (WHERE action = 'assistant') AS first_hit, min(step) FILTER (WHERE action = 'assistant') - 1 AS detour FROM (SELECT *, row_number() OVER (PARTITION BY attempt, action ORDER BY step) AS rn FROM turns) GROUP BY 1"))


def wn13(spark, d):
    return O.ordered_progress(V.turns(spark, d), "attempt", "step", "action", ["user", "assistant", "user", "assistant"])


_add("wn13_waypoint_progress", wn13, oracle(TURNS, """route AS (SELECT * FROM (VALUES (1, 'user'), (2, 'assistant'), (3, 'user'), (4, 'assistant')) r(i, want))""",
"""hop1 AS (SELECT attempt, min(step) FILTER (WHERE action = 'user') AS s1 FROM turns GROUP BY 1)""",
"hop2 AS (SELECT h.attempt, s1, min(step) FILTER (WHERE action = 'assistant' AND step > s1) AS s2 FROM hop1 h JOIN turns USING (attempt) GROUP BY 1, 2)",
"hop3 AS (SELECT h.attempt, s1, s2, min(step) FILTER (WHERE action = 'user' AND step > s2) AS s3 FROM hop2 h JOIN turns USING (attempt) GROUP BY 1, 2, 3)",
"hop4 AS (SELECT h.attempt, s1, s2, s3, min(step) FILTER (WHERE action = 'assistant' AND step > s3) AS s4 FROM hop3 h JOIN turns USING (attempt) GROUP BY 1, 2, 3, 4)",
body="SELECT attempt, CASE WHEN s1 IS NULL THEN 0 WHEN s2 IS NULL THEN 1 WHEN s3 IS NULL THEN 2 WHEN s4 IS NULL THEN 3 ELSE 4 END AS reached FROM hop4"))
_add("wn14_running_score", lambda s, d: O.running_sum(V.log(s, d), ["case_id"], ["line_no"], "k", "total").select("case_id", "line_no", "total"),
     oracle(LOG, body="SELECT case_id, line_no, CAST(sum(k) OVER (PARTITION BY case_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM log"))


def wn15(spark, d):
    rows = O.log_softmax(V.log(spark, d).where("slot = 'gate'"), ["model", "case_id"], F.col("k") / 10.0, "logp")
    return rows.select("line_no", F.round("logp", 6).alias("logp"))


_add("wn15_log_softmax", wn15, oracle(LOG, """x AS (SELECT line_no, model, case_id, k / 10.0 AS s, max(k / 10.0) OVER (PARTITION BY model, case_id) AS m FROM log WHERE slot = 'gate')""",
     body="SELECT line_no, round(s - m - ln(sum(exp(s - m)) OVER (PARTITION BY model, case_id)), 6) AS logp FROM x"))
_add("wn16_rank_of_expected", lambda s, d: O.ranked(V.log(s, d), ["model", "case_id"], [F.desc("k"), "line_no"], "place").where("label = 'correct'").select("line_no", F.col("place").cast("long").alias("place")),
     oracle(LOG, body="SELECT line_no, place FROM (SELECT *, row_number() OVER (PARTITION BY model, case_id ORDER BY k DESC, line_no) AS place FROM log) WHERE label = 'correct'"))
def wn17(spark, d):
    """A schedule for every case: its distances as items, a round for each of its log lines."""
    groups = V.log(spark, d).groupBy("case_id").agg(F.array_sort(F.collect_set("distance")).alias("items"), F.count("*").alias("rounds"))
    return O.round_schedules(groups, "case_id", "items", "rounds", 4, "seed")


_add("wn17_round_schedule", wn17, oracle(LOG, "g AS (SELECT case_id, count(*) AS rounds, count(DISTINCT distance) AS n FROM log GROUP BY 1)", "v AS (SELECT DISTINCT case_id, CAST(distance AS VARCHAR) AS item FROM log WHERE distance IS NOT NULL)",
     "slots AS (SELECT case_id, n, r, r - 1 - (r - 1) // 4 AS i FROM (SELECT case_id, n, unnest(range(1, rounds + 1)) AS r FROM g))",
     "laps AS (SELECT DISTINCT case_id, i // n AS lap FROM slots WHERE n > 0)", "o AS (SELECT laps.case_id, lap, item, row_number() OVER (PARTITION BY laps.case_id, lap ORDER BY sha256('seed|' || CAST(laps.case_id AS VARCHAR) || '|' || CAST(lap AS VARCHAR) || '|' || item)) - 1 AS j FROM laps JOIN v ON v.case_id = laps.case_id)",
     body="SELECT s.case_id, r AS round_no, coalesce(item, 'distractor') AS item FROM slots s LEFT JOIN o ON s.r % 4 <> 0 AND n > 0 AND o.case_id = s.case_id AND o.lap = s.i // s.n AND o.j = s.i % s.n"))


def wn18(spark, d):
    span = V.facts(spark, d).agg(F.min("start").alias("a"), F.max("start").alias("b"))
    return span.select(F.explode(T.time_buckets(F.col("a"), F.col("b"), 7)).alias("x")).select(F.col("x.bucket").cast("long").alias("bucket"), "x.first", "x.last")


_add("wn18_time_buckets", wn18, oracle(FACTS, "span AS (SELECT min(start) AS a, max(start) AS b FROM facts)", body="""
SELECT k AS bucket, a + CAST((date_diff('day', a, b) + 1) * k // 7 AS INTEGER) AS first, a + CAST((date_diff('day', a, b) + 1) * (k + 1) // 7 AS INTEGER) - 1 AS last FROM span, range(7) t(k)"""))  # fmt: skip


def wn19(spark, d):
    f = V.facts(spark, d).where("property = 'click'")
    return O.stratified(f, F.floor(F.datediff("start", F.lit("2024-01-01").cast("date")) / 6), [F.desc("start"), "fact_id"], 37, 5).select("fact_id", "start", F.col("stratum").cast("long").alias("stratum"))


_add("wn19_stratified_sample", wn19, oracle(FACTS, body="""
SELECT fact_id, start, stratum FROM (SELECT fact_id, start, date_diff('day', DATE '2024-01-01', start) // 6 AS stratum, row_number() OVER (PARTITION BY date_diff('day', DATE '2024-01-01', start) // 6 ORDER BY start DESC, fact_id) AS rn FROM facts WHERE property = 'click')
WHERE stratum BETWEEN 0 AND 4 AND rn <= 7 + CASE WHEN stratum < 2 THEN 1 ELSE 0 END"""))  # fmt: skip


def wn20(spark, d):
    w = Window.partitionBy("attempt").orderBy("step")
    return V.turns(spark, d).withColumn("batch", F.floor((F.row_number().over(w) - 1) / 4)).groupBy("attempt", "batch").agg(F.count("*").alias("n"), F.min("step").alias("first_step"))


_add("wn20_microbatches", wn20, oracle(TURNS, body="SELECT attempt, (rn - 1) // 4 AS batch, count(*) AS n, min(step) AS first_step FROM (SELECT *, row_number() OVER (PARTITION BY attempt ORDER BY step) AS rn FROM turns) GROUP BY 1, 2"))


def wn21(spark, d):
    p = V.anchors(spark, d).join(V.table(spark, d, "pages").select("page_id", F.col("html").alias("content")), "page_id")
    return O.document_order(p, ["page_id"], "content", F.concat(F.lit(">"), F.col("target"), F.lit("<")), "pos").select("page_id", "pos", F.col("place").cast("long").alias("place"))


_add("wn21_document_order", wn21, oracle(ANCHORS, """x AS (SELECT a.page_id, a.pos, strpos(p.html, '>' || a.target || '<') AS spot, length(p.html) AS n FROM anchors a JOIN pages p USING (page_id))""",
     body="SELECT page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN spot = 0 THEN n + pos ELSE spot END, pos) AS place FROM x"))
