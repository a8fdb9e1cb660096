"""Scans, sources, sinks and set operations over the driver tables."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from strataline.operators import nested as NE
from strataline.operators import ordering as O
from strataline.operators import temporal as T
from strataline.operators.staging import shared_folder
from strataline.sources import log as G
from strataline.sources import views as V
from strataline.sources.views import ANCHORS, FACTS, LOG, REVISIONS, oracle

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_add("sc01_revision_at", lambda s, d: V.revisions(s, d).where("ts <= timestamp '1998-01-01 23:59:59'").groupBy("page").agg(F.max_by("revision_id", F.struct("ts", "revision_id")).alias("revision_id")),
     oracle(REVISIONS, body="SELECT page, arg_max(revision_id, (ts, revision_id)) AS revision_id FROM revisions WHERE ts <= TIMESTAMP '1998-01-01 23:59:59' GROUP BY 1"))
_add("sc03_exact_revision", lambda s, d: V.revisions(s, d).where("revision_id = 77"), oracle(REVISIONS, body="SELECT * FROM revisions WHERE revision_id = 77"))
_add("sc04_parse_once", lambda s, d: V.table(s, d, "documents").groupBy(F.sha2("text", 256).alias("content")).agg(F.min("doc_id").alias("parsed_as"), F.count("*").alias("requests")),
     "SELECT sha256(text) AS content, min(doc_id) AS parsed_as, count(*) AS requests FROM documents WHERE text IS NOT NULL GROUP BY 1")


def sc05(s, d):
    alias = V.table(s, d, "lineitem").select((F.col("l_orderkey") % 3000).alias("alias_key"), F.col("l_partkey").alias("page_key")).groupBy("alias_key").agg(F.min("page_key").alias("page_key"))
    req = V.table(s, d, "orders").select(F.col("o_orderkey").alias("key"))
    page = V.table(s, d, "part").select(F.col("p_partkey").alias("page_key"), "p_brand")
    r = req.join(alias, req.key == alias.alias_key, "left").select("key", F.coalesce("page_key", "key").alias("page_key"))
    return r.join(page, "page_key", "left").select("key", "p_brand")


_add("sc05_alias_scan", sc05, "WITH a AS (SELECT l_orderkey % 3000 AS k, min(l_partkey) AS p FROM lineitem GROUP BY 1) SELECT o_orderkey AS key, p_brand FROM orders LEFT JOIN a ON o_orderkey = k LEFT JOIN part ON p_partkey = coalesce(p, o_orderkey)")


SC06_SINCE, SC06_UNTIL = date(1996, 1, 1), date(1999, 12, 31)


def _edit_days(s, d):
    """Distinct edit dates of the window, with their number for each page."""
    days = V.revisions(s, d).where(F.to_date("ts").between(F.lit(SC06_SINCE), F.lit(SC06_UNTIL))).select("page", F.to_date("ts").alias("day")).distinct()
    return days.withColumn("n", F.count("*").over(Window.partitionBy("page")))


def sc06(s, d):
    return _edit_days(s, d).where("n <= 6").select("page", "day")


def sc06_probes(s, d):
    """The rest of sc06: pages over its cap, with the edit dates met by 20 evenly spaced probes."""
    span = (SC06_UNTIL - SC06_SINCE).days
    dates = F.array(*[F.lit(SC06_SINCE + timedelta(days=round(span * k / 19))) for k in range(20)])
    busy = _edit_days(s, d).where("n > 6").select("page").distinct()
    points = busy.select("page", F.explode(dates).alias("probe")).withColumn("at", T.end_of_day(F.col("probe")).cast(V.revisions(s, d).schema["ts"].dataType))
    versions = V.revisions(s, d).select("page", "ts", "revision_id").join(busy, "page", "left_semi")
    met = T.as_of(points, versions, "page", "at", "ts", "revision_id").select("page", F.to_date("version.ts").alias("day"))
    return met.where(F.col("day") >= F.lit(SC06_SINCE)).distinct()


_add("sc06_revision_dates", sc06, oracle(REVISIONS, body="SELECT page, day FROM (SELECT page, day, count(*) OVER (PARTITION BY page) AS n FROM (SELECT DISTINCT page, CAST(ts AS DATE) AS day FROM revisions WHERE CAST(ts AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')) WHERE n <= 6"))
_add("sc06_revision_date_probes", sc06_probes, oracle(REVISIONS, "days AS (SELECT DISTINCT page, CAST(ts AS DATE) AS day FROM revisions)", "busy AS (SELECT page FROM days WHERE day BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1 HAVING count(*) > 6)", "probe AS (SELECT DATE '1996-01-01' + CAST(round(1460.0 * k / 19) AS INTEGER) AS asked FROM range(20) t(k))",
     body="SELECT DISTINCT page, day FROM (SELECT page, asked, max(day) AS day FROM days JOIN busy USING (page) JOIN probe ON day <= asked GROUP BY 1, 2) WHERE day >= DATE '1996-01-01'"))
_add("sc07_paginated_revisions", lambda s, d: O.ranked(V.revisions(s, d), ["page"], ["ts", "revision_id"], "rn").select("page", "revision_id", F.floor((F.col("rn") - 1) / 4).alias("page_no"), ((F.col("rn") % 4) == 0).alias("page_end")),
     oracle(REVISIONS, body="SELECT page, revision_id, (rn - 1) // 4 AS page_no, rn % 4 = 0 AS page_end FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ts, revision_id) AS rn FROM revisions)"))
_add("sc08_entity_batch", lambda s, d: V.table(s, d, "part").join(V.facts(s, d).select(F.col("object").alias("p_partkey")).distinct(), "p_partkey", "left_semi").select("p_partkey", "p_name", "p_brand"),
     oracle(FACTS, body="SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey IN (SELECT object FROM facts)"))


def sc09(s, d):
    V.facts(s, d).createOrReplaceTempView("strataline_facts")
    return s.sql("SELECT property, rank, count(*) AS n, count(DISTINCT object) AS objects FROM strataline_facts WHERE start > DATE '2024-01-10' GROUP BY property, rank")


_add("sc09_query_text", sc09, oracle(FACTS, body="SELECT property, rank, count(*) AS n, count(DISTINCT object) AS objects FROM facts WHERE start > DATE '2024-01-10' GROUP BY 1, 2"))
_add("sc10_event_windows", lambda s, d: V.table(s, d, "orders").where("o_orderdate > timestamp '1996-01-01' and o_orderdate <= timestamp '2000-01-01'").groupBy(F.floor((F.datediff("o_orderdate", F.lit("1996-01-01").cast("date")) - 1) / 180).alias("win")).agg(F.count("*").alias("n"), (F.count("*") >= 900).alias("saturated")),
     "SELECT (date_diff('day', DATE '1996-01-01', CAST(o_orderdate AS DATE)) - 1) // 180 AS win, count(*) AS n, count(*) >= 900 AS saturated FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '2000-01-01' GROUP BY 1")
_add("sc11_property_mining", lambda s, d: V.facts(s, d).where("start between date '2024-01-05' and date '2024-01-12'").groupBy("property").agg(F.count("*").alias("statements"), F.countDistinct("subject").alias("entities")),
     oracle(FACTS, body="SELECT property, count(*) AS statements, count(DISTINCT subject) AS entities FROM facts WHERE start BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY 1"))


def sc12(s, d):
    top = V.anchors(s, d).where("target not in ('-', 'Main_Page') and target not like 'Special:%'").groupBy(F.lower("target").alias("title")).agg(F.count("*").alias("n"), F.min_by("target", F.struct("page_id", "pos")).alias("shown"))
    return top.select("title", "shown", F.greatest(F.col("n") - 2, F.lit(0)).alias("views"))


_add("sc12_popularity_scan", sc12, oracle(ANCHORS, body="SELECT lower(target) AS title, arg_min(target, (page_id, pos)) AS shown, greatest(count(*) - 2, 0) AS views FROM anchors WHERE target NOT IN ('-', 'Main_Page') AND target NOT LIKE 'Special:%' GROUP BY 1"))
_add("sc13_last_complete_month", lambda s, d: V.table(s, d, "orders").select(F.date_format(F.add_months(F.trunc("o_orderdate", "MM"), -1), "yyyy-MM").alias("month")).groupBy("month").agg(F.count("*").alias("n")),
     "SELECT strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")


def sc14(s, d):
    lines = V.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, F.lit("{bad")).otherwise(F.col("props")).alias("line"))
    row = F.from_json("line", "k long, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return lines.select("event_id", row.alias("r")).select("event_id", "r.k", F.col("r.corrupt").isNotNull().alias("is_error"))


_add("sc14_skip_bad_lines", sc14, "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 50 = 0 AS is_error FROM events")
_add("sc15_fail_fast_lines", lambda s, d: V.table(s, d, "events").select("event_id", F.from_json("props", "k long", {"mode": "FAILFAST"}).alias("r")).select("event_id", "r.k"), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
_add("sc16_typed_documents", lambda s, d: V.table(s, d, "events").select("event_id", F.from_json(F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", '"k"', '"other"')).otherwise(F.col("props")), "k long, other long").alias("r")).select("event_id", "r.k", "r.other", F.col("r.k").isNull().alias("incomplete")),
     "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS other, event_id % 3 = 0 AS incomplete FROM events")


def sc17(s, d):
    reg = s.createDataFrame([("click", "point", "active"), ("view", "range", "active"), ("error", "range", "quarantine")], "property string, time_mode string, status string")
    return V.facts(s, d).join(F.broadcast(reg), "property").groupBy("property", "time_mode", "status").agg(F.count("*").alias("n"))


_add("sc17_registry", sc17, oracle(FACTS, "r AS (SELECT * FROM (VALUES ('click', 'point', 'active'), ('view', 'range', 'active'), ('error', 'range', 'quarantine')) v(property, time_mode, status))", body="SELECT property, time_mode, status, count(*) AS n FROM facts JOIN r USING (property) GROUP BY 1, 2, 3"))
_add("sc18_event_seeds", lambda s, d: V.facts(s, d).where("start > date '2024-01-10' and start <= date '2024-01-20' and object <> subject").select("subject", "object", "start").dropDuplicates(),
     oracle(FACTS, body="SELECT DISTINCT subject, object, start FROM facts WHERE start > DATE '2024-01-10' AND start <= DATE '2024-01-20' AND object <> subject"))


def sc19(s, d):
    cut = s.createDataFrame([("click", "2024-01-08"), ("view", "2024-01-12")], "model string, cutoff string").withColumn("cutoff", F.to_date("cutoff"))
    return V.log(s, d).withColumn("name", F.upper("model")).join(F.broadcast(cut), F.lower("name") == cut.model).where(F.to_date("ts") > F.col("cutoff")).select("line_no", "cutoff")


_add("sc19_model_cutoff", sc19, oracle(LOG, "c AS (SELECT * FROM (VALUES ('click', DATE '2024-01-08'), ('view', DATE '2024-01-12')) v(model, cutoff))", body="SELECT line_no, cutoff FROM log JOIN c USING (model) WHERE CAST(ts AS DATE) > cutoff"))


def _nested(s, d):
    """Events whose properties are wrapped in pages within pages, up to five deep."""
    wrapped = "CASE WHEN event_id % 6 = 0 THEN props ELSE aggregate(sequence(1, cast(event_id % 6 AS int)), props, (t, i) -> concat('{\"page\":[', t, ',{\"k\":', event_id, '}]}')) END"
    return V.table(s, d, "events").select("event_id", F.parse_json(F.expr(wrapped)).alias("v"))


_add("sc20_nested_evidence", lambda s, d: NE.named_values(_nested(s, d), "event_id", "v", ["k"]),
     """SELECT event_id, '$' || repeat('.page[0]', event_id % 6) || '.k' AS path, json_extract_string(props, '$.k') AS leaf FROM events
UNION ALL SELECT event_id, '$' || repeat('.page[0]', j) || '.page[1].k', CAST(event_id AS VARCHAR) FROM (SELECT event_id, unnest(range(0, event_id % 6)) AS j FROM events)""")  # fmt: skip
_add("pr13_private_values", lambda s, d: NE.private_leaks(NE.leaves(_nested(s, d).where("event_id % 6 > 3"), "event_id", "v"), "event_id", V.table(s, d, "region").select((F.col("r_regionkey") + 7).cast("string").alias("s")), "s", "^(gold|expected)$", F.lit(False)),
     """SELECT event_id, '$' || repeat('.page[0]', event_id % 6) || '.k' AS path, 'value' AS reason FROM events WHERE event_id % 6 > 3 AND json_extract_string(props, '$.k') IN (SELECT CAST(r_regionkey + 7 AS VARCHAR) FROM region)
UNION ALL SELECT event_id, '$' || repeat('.page[0]', j) || '.page[1].k', 'value' FROM (SELECT event_id, unnest(range(0, event_id % 6)) AS j FROM events WHERE event_id % 6 > 3 AND CAST(event_id AS VARCHAR) IN (SELECT CAST(r_regionkey + 7 AS VARCHAR) FROM region))""")  # fmt: skip


def sc21(s, d):
    ids = V.table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids")).select("o_custkey", F.posexplode(F.transform("ids", lambda x: x % 7)).alias("pos", "id"))
    return ids.groupBy("o_custkey", "id").agg(F.min("pos").cast("long").alias("pos"))


_add("sc21_seed_ids", sc21, "SELECT o_custkey, o_orderkey % 7 AS id, min(rn) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn FROM orders) GROUP BY 1, 2")


def sc22(s, d):
    f = V.facts(s, d)
    inside = lambda c: F.col(c).between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date"))
    hit = F.when(F.col("property").isin("click", "signup"), inside("start")).otherwise(inside("start") | inside("end"))
    arts = V.table(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"))
    return f.where(hit).join(arts, f.object == arts.id, "left_semi").select("subject", "property", "object", "start").distinct()


_add("sc22_relation_sample", sc22, oracle(FACTS, body="""SELECT DISTINCT subject, property, object, start FROM facts WHERE CASE WHEN property IN ('click', 'signup') THEN start BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' ELSE start BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' OR coalesce("end" BETWEEN DATE '2024-01-10' AND DATE '2024-01-12', false) END AND object IN (SELECT p_partkey FROM part WHERE p_size > 10)"""))
_add("sc23_assignments_after", lambda s, d: V.facts(s, d).where("property = 'view' and start > date '2024-01-20'").orderBy("start", "fact_id").limit(100).select("fact_id", "start"),
     oracle(FACTS, body="SELECT fact_id, start FROM facts WHERE property = 'view' AND start > DATE '2024-01-20' ORDER BY start, fact_id LIMIT 100"))
_add("sc24_average_views", lambda s, d: V.table(s, d, "part").select("p_partkey").join(V.table(s, d, "lineitem").where("l_shipdate >= timestamp '1999-01-01'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("total"), F.count("*").alias("days")), "p_partkey", "left"),
     "SELECT p_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, CASE WHEN count(l_partkey) > 0 THEN count(l_partkey) END AS days FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY 1")
_add("sc25_normalised_events", lambda s, d: V.facts(s, d).where("object is not null and start is not null and subject <> object").select("subject", "property", "object", "start").distinct(),
     oracle(FACTS, body="SELECT DISTINCT subject, property, object, start FROM facts WHERE object IS NOT NULL AND start IS NOT NULL AND subject <> object"))

# sinks and state
_add("sk01_page_upsert", lambda s, d: G.upsert(V.links(s, d), V.links(s, d).where("source % 3 = 0 and target % 2 = 0").withColumn("pos", F.lit(-1).cast("long")), ["source"]),
     oracle(V.LINKS, body="SELECT * FROM links WHERE source NOT IN (SELECT source FROM links WHERE source % 3 = 0 AND target % 2 = 0) UNION ALL SELECT source, target, -1 FROM links WHERE source % 3 = 0 AND target % 2 = 0"))
_add("sk02_revision_upsert", lambda s, d: G.upsert(V.revisions(s, d).select("revision_id", "size"), V.revisions(s, d).where("page % 10 = 0").select("revision_id", (F.col("size") + 1).alias("size")), ["revision_id"]),
     oracle(REVISIONS, body="SELECT revision_id, CASE WHEN page % 10 = 0 THEN size + 1 ELSE size END AS size FROM revisions"))


def sk06(s, d):
    log = V.log(s, d)
    old = log.where("line_no % 2 = 0").groupBy("k").agg(F.count("*").alias("attempts"), F.min("ts").alias("first_seen"), F.max_by("label", "line_no").alias("status"))
    new = log.where("line_no % 2 = 1 and k > 50").select("k", F.col("ts").alias("seen"), F.col("label").alias("status"), "line_no")
    return G.ledger_merge(old, new, "k")


_add("sk06_ledger_upsert", sk06, oracle(LOG, body="SELECT k, count(*) AS attempts, min(ts) AS first_seen, coalesce(arg_max(label, line_no) FILTER (WHERE line_no % 2 = 1), arg_max(label, line_no)) AS status FROM log WHERE line_no % 2 = 0 OR k > 50 GROUP BY 1"))
_add("sk07_status_counts", lambda s, d: V.log(s, d).groupBy("label").agg(F.count("*").alias("n")), oracle(LOG, body="SELECT label, count(*) AS n FROM log GROUP BY 1"))
_add("sk08_ledger_exclusion", lambda s, d: V.facts(s, d).select("fact_id", F.col("object").alias("k")).join(V.log(s, d).where("label in ('correct', 'stick_new') and slot = 'gate' and model = 'view'").select("k").distinct(), "k", "left_anti"),
     oracle(FACTS, LOG, body="SELECT fact_id, object AS k FROM facts WHERE object NOT IN (SELECT k FROM log WHERE label IN ('correct', 'stick_new') AND slot = 'gate' AND model = 'view')"))
_add("sk11_usage_rollup", lambda s, d: V.log(s, d).groupBy("model", "slot").agg(F.count("*").alias("calls"), F.count_if(F.col("repeat") == 0).alias("cached"), F.sum("k").alias("tokens")),
     oracle(LOG, body="SELECT model, slot, count(*) AS calls, count(*) FILTER (WHERE repeat = 0) AS cached, CAST(sum(k) AS BIGINT) AS tokens FROM log GROUP BY 1, 2"))


def sk12(s, d):
    log = V.log(s, d).select("line_no", "model", F.col("k").cast("string").alias("content"))
    cache = log.where("line_no % 4 = 0").select(G.content_address("model", "content").alias("cache_key")).distinct()
    return G.cached_misses(log, cache, ["model", "content"])[1].select("line_no")


_add("sk12_cache_misses", sk12, oracle(LOG, body="SELECT line_no FROM log a WHERE NOT EXISTS (SELECT 1 FROM log b WHERE b.line_no % 4 = 0 AND b.model = a.model AND b.k = a.k)"))
_add("sk14_evidence_table", lambda s, d: V.table(s, d, "pages").select(F.concat(F.lit("evidence_"), F.substring(F.sha2("html", 256), 1, 24)).alias("evidence_id"), F.size(F.regexp_extract_all("html", F.lit("<a href"), 0)).cast("long").alias("n_links")).distinct(),
     "SELECT DISTINCT 'evidence_' || substring(sha256(html), 1, 24) AS evidence_id, CAST(len(regexp_extract_all(html, '<a href')) AS BIGINT) AS n_links FROM pages")
_add("sk15_review_template", lambda s, d: V.table(s, d, "benchmark").select("item_id", F.sha2("text", 256).alias("case_hash"), F.lit("draft").alias("decision"), F.lit(False).alias("admissible")),
     "SELECT item_id, sha256(text) AS case_hash, 'draft' AS decision, false AS admissible FROM benchmark")

# set operations
_add("st01_union_last_wins", lambda s, d: O.last_wins(V.log(s, d).where("slot = 'pk'").unionByName(V.log(s, d).where("slot = 'gate'")), ["k", "model"], "line_no").select("k", "model", "line_no", "slot"),
     oracle(LOG, body="SELECT k, model, max(line_no) AS line_no, arg_max(slot, line_no) AS slot FROM log WHERE slot IN ('pk', 'gate') GROUP BY 1, 2"))


def st02(s, d):
    f = V.facts(s, d)
    a = f.select("property", F.lit("forward").alias("direction"), F.col("object").alias("qid"), "start", "fact_id")
    b = f.select("property", F.lit("inverse").alias("direction"), F.col("subject").alias("qid"), "start", "fact_id")
    return O.last_wins(a.unionByName(b), ["property", "direction", "qid", "start"], "fact_id")


_add("st02_forward_and_inverse", st02, oracle(FACTS, body="SELECT property, 'forward' AS direction, object AS qid, start, max(fact_id) AS fact_id FROM facts GROUP BY 1, 2, 3, 4 UNION ALL SELECT property, 'inverse', subject, start, max(fact_id) FROM facts GROUP BY 1, 2, 3, 4"))
_add("st03_exclusion", lambda s, d: V.facts(s, d).select("subject", "object").exceptAll(V.facts(s, d).where("rank = 'deprecated'").select("subject", "object")),
     oracle(FACTS, body="SELECT subject, object FROM facts EXCEPT ALL SELECT subject, object FROM facts WHERE rank = 'deprecated'"))
_add("st04_intersection", lambda s, d: V.facts(s, d).where("property = 'view'").select("object").intersect(V.facts(s, d).where("property = 'error'").select("object")),
     oracle(FACTS, body="SELECT object FROM facts WHERE property = 'view' INTERSECT SELECT object FROM facts WHERE property = 'error'"))


def st06(s, d):
    g = V.log(s, d).groupBy("case_id").agg(F.collect_set(F.when(F.col("slot") == "pk", F.col("k"))).alias("offered"), F.collect_set(F.when(F.col("slot") == "gate", F.col("k"))).alias("returned"))
    return g.select("case_id", F.size(F.array_except("offered", "returned")).cast("long").alias("missing"), F.size(F.array_except("returned", "offered")).cast("long").alias("unexpected"))


_add("st06_dense_ids", st06, oracle(LOG, "o AS (SELECT DISTINCT case_id, k FROM log WHERE slot = 'pk')", "r AS (SELECT DISTINCT case_id, k FROM log WHERE slot = 'gate')", body="SELECT case_id, count(*) FILTER (WHERE r.k IS NULL AND o.k IS NOT NULL) AS missing, count(*) FILTER (WHERE o.k IS NULL AND r.k IS NOT NULL) AS unexpected FROM (SELECT DISTINCT case_id FROM log) c LEFT JOIN (SELECT coalesce(o.case_id, r.case_id) AS case_id, o.k AS ok, r.k AS rk FROM o FULL JOIN r ON o.case_id = r.case_id AND o.k = r.k) x USING (case_id) LEFT JOIN o ON o.case_id = c.case_id AND o.k = ok LEFT JOIN r ON r.case_id = c.case_id AND r.k = rk GROUP BY 1"))


def st07(s, d):
    base = V.log(s, d).where("slot = 'pk'").groupBy("k").agg(F.lit("active").alias("base_status")).where("k < 60")
    found = V.log(s, d).where("slot = 'gate'").groupBy("k").agg(F.count_if(F.col("label") == "correct").alias("good")).where("k > 40")
    m = base.join(found, "k", "full")
    return m.select("k", F.when(F.col("base_status").isNull() & (F.col("good") >= 5), "validated").when(F.col("base_status").isNull(), "quarantine").otherwise(F.col("base_status")).alias("status"), F.col("base_status").isNull().alias("is_new"))


_add("st07_registry_merge", st07, oracle(LOG, "b AS (SELECT DISTINCT k FROM log WHERE slot = 'pk' AND k < 60)", "f AS (SELECT k, count(*) FILTER (WHERE label = 'correct') AS good FROM log WHERE slot = 'gate' AND k > 40 GROUP BY 1)", body="SELECT coalesce(b.k, f.k) AS k, CASE WHEN b.k IS NULL AND good >= 5 THEN 'validated' WHEN b.k IS NULL THEN 'quarantine' ELSE 'active' END AS status, b.k IS NULL AS is_new FROM b FULL JOIN f ON b.k = f.k"))

# sort, limit, top-k
_add("so01_beam_top_k", lambda s, d: O.top_k(V.log(s, d), F.col("k"), F.col("line_no"), "s", 50).select("line_no", "k"), oracle(LOG, body="SELECT line_no, k FROM log ORDER BY k DESC, sha256('s|' || CAST(line_no AS VARCHAR)) LIMIT 50"))
_add("so02_expansion_cap", lambda s, d: O.capped(V.log(s, d), "case_id", [F.desc("k"), "line_no"], 3, 200).select("case_id", "line_no"), oracle(LOG, body="SELECT case_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY k DESC, line_no) AS rn FROM log) WHERE rn <= 3 ORDER BY case_id, rn LIMIT 200"))


def so03(s, d):
    log = V.log(s, d).withColumn("reserved", F.col("label") == "other")
    n = F.count_if("reserved").over(Window.partitionBy("case_id"))
    r = F.row_number().over(Window.partitionBy("case_id", "reserved").orderBy("line_no"))
    return log.withColumn("n", n).withColumn("r", r).where("reserved or r <= greatest(30 - n, 0)").select("case_id", "line_no")


_add("so03_compaction", so03, oracle(LOG, body="SELECT case_id, line_no FROM (SELECT *, count(*) FILTER (WHERE label = 'other') OVER (PARTITION BY case_id) AS n, row_number() OVER (PARTITION BY case_id, label = 'other' ORDER BY line_no) AS r FROM log) WHERE label = 'other' OR r <= greatest(30 - n, 0)"))
_add("so07_hash_pick", lambda s, d: V.log(s, d).select("line_no", O.hash_pick(F.lit(17), F.concat(F.lit("case|"), F.col("line_no").cast("string"))).alias("pick")),
     "SELECT event_id AS line_no, CAST(CAST('0x' || substring(sha256('case|' || CAST(event_id AS VARCHAR)), 1, 16) AS UBIGINT) % 17 AS BIGINT) AS pick FROM events")
_add("so08_total_order", lambda s, d: V.anchors(s, d).select("page_id", "pos", F.row_number().over(Window.partitionBy("page_id").orderBy(F.lower("target"), "target", "pos")).cast("long").alias("place")),
     oracle(ANCHORS, body="SELECT page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY lower(target), target, pos) AS place FROM anchors"))
_add("so09_saturation", lambda s, d: V.facts(s, d).groupBy("object").agg(F.count("*").alias("n"), (F.count("*") >= 100).alias("saturated")), oracle(FACTS, body="SELECT object, count(*) AS n, count(*) >= 100 AS saturated FROM facts GROUP BY 1"))
_add("so10_link_page", lambda s, d: O.ranked(V.anchors(s, d).where(F.contains(F.lower("target"), F.lit("th"))), ["page_id"], ["pos"], "rn").where("rn between 2 and 4").select("page_id", "target", F.col("rn").cast("long").alias("rn")),
     oracle(ANCHORS, body="SELECT page_id, target, rn FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM anchors WHERE contains(lower(target), 'th')) WHERE rn BETWEEN 2 AND 4"))
_add("fn23_file_fingerprint", lambda s, d: G.file_fingerprints(s, f"{d}/*.parquet").select(F.regexp_extract("path", "([^/]+[.]parquet(/.*)?)$", 1).alias("file"), "length", "sha256"))


def _state(s, d):
    return V.log(s, d).groupBy("model", "arm").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


def sk03(s, d):
    """A store made from one arm, more rows of the other, read back."""
    path = f"{shared_folder(s)}/store-{uuid.uuid4().hex}"
    G.append_new(_state(s, d).where("arm = 'control'"), path)
    G.append_more(_state(s, d).where("arm = 'conflict'"), path)
    return s.read.parquet(path)


def sk04(s, d):
    """A second store at the same path is refused, and the first stays."""
    path = f"{shared_folder(s)}/store-{uuid.uuid4().hex}"
    G.append_new(_state(s, d), path)
    refused = False
    try:
        G.append_new(_state(s, d).withColumn("n", F.lit(0).cast("long")), path)
    except AnalysisException:
        refused = True
    return s.read.parquet(path).withColumn("refused", F.lit(refused))


def sk05(s, d):
    """A document is replaced whole; the variant that refuses leaves it."""
    path = f"{shared_folder(s)}/document-{uuid.uuid4().hex}.json"
    G.replace_document(_state(s, d).withColumn("n", F.lit(0).cast("long")), path)
    G.replace_document(_state(s, d), path)
    refused = False
    try:
        G.replace_document(_state(s, d).limit(1), path, refuse=True)
    except FileExistsError:
        refused = True
    return G.read_document(s, path, "model string, arm string, n long, k long").withColumn("refused", F.lit(refused))


_STATE_SQL = "SELECT model, arm, count(*) AS n, CAST(sum(k) AS BIGINT) AS k{} FROM log GROUP BY 1, 2"
_add("sk03_result_store", sk03, oracle(LOG, body=_STATE_SQL.format("")))
_add("sk04_no_overwrite", sk04, oracle(LOG, body=_STATE_SQL.format(", true AS refused")))
_add("sk05_atomic_replace", sk05, oracle(LOG, body=_STATE_SQL.format(", true AS refused")))
_add("sk09_score_report", lambda s, d: V.log(s, d).groupBy("model", "case_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "correct").alias("correct"), F.count_if(F.col("label") == "other").alias("other"), F.max("occurrence").alias("occurrences")).orderBy("model", "case_id"),
     oracle(LOG, body="SELECT model, case_id, count(*) AS n, count(*) FILTER (WHERE label = 'correct') AS correct, count(*) FILTER (WHERE label = 'other') AS other, max(occurrence) AS occurrences FROM log GROUP BY 1, 2"))
