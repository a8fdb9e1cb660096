"""Scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataline.functions import text as X
from strataline.operators import analytics as A
from strataline.operators import patterns as P
from strataline.sources import views as V
from strataline.sources.views import ANCHORS, FACTS, LOG, TURNS, oracle

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_add("fn01_normalise_title", lambda s, d: V.table(s, d, "part").select("p_partkey", X.normalise_title(F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("%20x+y  "))).alias("title")),
     "SELECT p_partkey, trim(regexp_replace(replace(replace(replace(p_type, ' ', '_'), '_', ' ') || ' x+y  ', '  ', ' '), '\\s+', ' ', 'g')) AS title FROM part")
_add("fn02_fold", lambda s, d: V.table(s, d, "documents").select("doc_id", F.sha2(X.fold("text"), 256).alias("folded")))
_add("fn02_fold_ascii", lambda s, d: V.table(s, d, "part").select("p_partkey", X.fold_ascii(F.concat(F.lit(" [[A|"), F.col("p_name"), F.lit("]]  "))).alias("folded")), "SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS folded FROM part")
_add("fn03_strict_date", lambda s, d: V.table(s, d, "orders").select("o_orderkey", X.strict_date(F.concat(F.lit("2024-"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0"))).alias("day")),
     "SELECT o_orderkey, try_cast('2024-' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') AS DATE) AS day FROM orders")
_add("fn04_time_literal", lambda s, d: V.table(s, d, "orders").select("o_orderkey", X.time_literal(F.concat(F.lit("+2023-"), F.lpad((F.col("o_orderkey") % 13).cast("string"), 2, "0"), F.lit("-11T00:00:00Z"))).alias("day")),
     "SELECT o_orderkey, try_cast('2023-' || lpad(CAST(o_orderkey % 13 AS VARCHAR), 2, '0') || '-11' AS DATE) AS day FROM orders")
_add("fn05_qualifier_policy", lambda s, d: V.facts(s, d).groupBy("subject", "object").agg(F.collect_list("start").alias("x")).select("subject", "object", X.qualifier_date(F.col("x"), False).alias("latest"), X.qualifier_date(F.col("x"), True).alias("only")),
     oracle(FACTS, body="SELECT subject, object, max(start) AS latest, CASE WHEN count(DISTINCT start) = 1 THEN max(start) END AS only FROM facts GROUP BY 1, 2"))
_add("fn06_end_of_day", lambda s, d: V.table(s, d, "orders").select("o_orderkey", F.unix_timestamp(F.to_timestamp(F.to_date("o_orderdate"))).alias("t")).select("o_orderkey", (F.col("t") + 86399).alias("as_of")),
     "SELECT o_orderkey, CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) + 86399 AS as_of FROM orders")


def fn07(s, d):
    f = V.facts(s, d)
    inside = lambda c: F.when(F.col(c).between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-18").cast("date")), F.col(c))
    return f.select("fact_id", F.when(F.col("property") == "click", F.coalesce(inside("end"), inside("start"))).otherwise(F.coalesce(inside("start"), inside("end"))).alias("day"))


W = "BETWEEN DATE '2024-01-08' AND DATE '2024-01-18'"
_add("fn07_effective_date", fn07, oracle(FACTS, f"""x AS (SELECT *, CASE WHEN start {W} THEN start END AS a, CASE WHEN "end" {W} THEN "end" END AS b FROM facts)""", body="SELECT fact_id, CASE WHEN property = 'click' THEN coalesce(b, a) ELSE coalesce(a, b) END AS day FROM x"))
_add("fn08_observation_date", lambda s, d: V.facts(s, d).select("fact_id", F.when(F.greatest("start", F.date_sub("end", 1)).between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date")), F.greatest("start", F.date_sub("end", 1))).otherwise(F.col("start")).alias("observed")),
     oracle(FACTS, body="""SELECT fact_id, CASE WHEN greatest(start, "end" - 1) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' THEN greatest(start, "end" - 1) ELSE start END AS observed FROM facts"""))
_add("fn09_id_from_uri", lambda s, d: V.facts(s, d).select("fact_id", F.regexp_extract(F.concat(F.lit("http://x.org/entity/Q"), F.col("object").cast("string")), "/([QP]\\d+)$", 1).alias("qid")), oracle(FACTS, body="SELECT fact_id, 'Q' || CAST(object AS VARCHAR) AS qid FROM facts"))
_add("fn10_character_window", lambda s, d: V.turns(s, d).select("attempt", "step", X.evidence_window(F.col("text"), F.lit(" the "), 20, 30).alias("window")),
     oracle(TURNS, "x AS (SELECT attempt, step, text, strpos(lower(text), ' the ') AS a FROM turns)", body="SELECT attempt, step, CASE WHEN a > 0 THEN substring(text, greatest(a - 20, 1), least(a - 1, 20) + 5 + 30) END AS window FROM x"))


def fn11(s, d):
    b = V.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "block"))
    score = F.size(F.regexp_extract_all(F.lower("block"), F.lit("the"), 0)) * 10 - F.length("block")
    return b.withColumn("u", score).groupBy("doc_id").agg(F.max(F.struct("u", (-F.col("i")).alias("n"))).alias("m")).select("doc_id", F.col("m.u").cast("long").alias("utility"), (-F.col("m.n")).cast("long").alias("block_no"))


_add("fn11_block_window", fn11, """WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
u AS (SELECT doc_id, i, CAST(len(regexp_extract_all(lower(block), 'the')) * 10 - length(block) AS BIGINT) AS u FROM b)
SELECT doc_id, max(u) AS utility, CAST(arg_min(i, (-u, i)) AS BIGINT) AS block_no FROM u GROUP BY 1""")
_add("fn12_excerpt", lambda s, d: V.table(s, d, "part").select("p_partkey", X.excerpt(F.concat_ws("  ", "p_name", "p_type", "p_brand"), 24).alias("short")),
     "SELECT p_partkey, CASE WHEN length(t) <= 24 THEN t ELSE rtrim(substring(t, 1, 23)) || '…' END AS short FROM (SELECT p_partkey, trim(regexp_replace(concat_ws('  ', p_name, p_type, p_brand), '\\s+', ' ', 'g')) AS t FROM part)")
_add("fn13_blocks", lambda s, d: V.table(s, d, "documents").select("doc_id", F.array_size(X.blocks(F.replace("text", F.lit("\n"), F.lit("\n\n")), white=X.SPACES)).cast("long").alias("n")),
     "SELECT doc_id, CAST(len([x FOR x IN string_split(text, chr(10)) IF length(trim(x)) >= 20]) AS BIGINT) AS n FROM documents")
_FIRST = {1: "^([^ .,]+)", 2: "^([^ .,]+ [^ .,]+)"}
ALIASES = {k: f"aliases AS (SELECT * FROM (SELECT item_id, regexp_extract(text, '{first}', 1) AS alias FROM benchmark) WHERE length(alias) > 2)" for k, first in _FIRST.items()}


def _aliases(s, d, words):
    """An alias table: the first words of the benchmark's items."""
    return V.table(s, d, "benchmark").select("item_id", F.regexp_extract("text", _FIRST[words], 1).alias("alias")).where("length(alias) > 2")


_add("fn14_alias_mention", lambda s, d: P.find_patterns(V.table(s, d, "documents"), _aliases(s, d, 2), ["doc_id"], "text", "item_id", "alias").select("doc_id", "item_id"),
     oracle(ALIASES[2], "near AS MATERIALIZED (SELECT doc_id, item_id, text, alias FROM documents, aliases WHERE contains(lower(text), lower(alias)))", body="SELECT doc_id, item_id FROM near WHERE regexp_matches(lower(text), '(^|[^\\pL\\pN_])' || regexp_escape(lower(alias)) || '($|[^\\pL\\pN_])')"))


def fn14_direct(s, d):
    """Answers made of part names, held against the name of the part and of the one before it."""
    name, k = F.col("p_name"), F.col("p_partkey") % 6
    said = (
        F.when(k == 0, F.upper(name)).when(k == 1, F.concat(F.lit("The  answer is '"), name, F.lit("'."))).when(k == 2, F.concat(F.lit("it was "), name, F.lit("!")))
        .when(k == 3, F.concat(F.lit("My final answer: "), name)).when(k == 4, F.concat(F.lit("not "), name)).otherwise(F.concat(F.lit("the page mentions "), name))
    )
    parts = V.table(s, d, "part").select("p_partkey", "p_name", said.alias("said"))
    before = parts.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return parts.join(before, "p_partkey").select("p_partkey", X.answers_directly(F.col("said"), F.col("p_name")).alias("direct"), X.answers_directly(F.col("said"), F.col("other")).alias("direct_other"), X.mentions(F.col("said"), F.col("p_name")).alias("mentioned"))


_add("fn14_direct_answer", fn14_direct, "SELECT a.p_partkey, a.p_partkey % 6 < 4 AS direct, a.p_partkey % 6 < 4 AND a.p_name = b.p_name AS direct_other, true AS mentioned FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1")


def fn15(s, d):
    """Errors of claims made of documents: the quoted evidence, the length of the answer, the cited ids."""
    docs = V.table(s, d, "documents").where("text is not null")
    quote = F.substring("text", 12, 40)
    evidence = F.when(F.col("doc_id") % 3 == 0, F.reverse(quote)).otherwise(F.replace(quote, F.lit(" "), F.lit("  ")))
    answer = F.array_join(F.slice(F.filter(F.split("text", "[ \\n]+"), lambda w: w != ""), 1, (F.col("doc_id") % 12).cast("int")), " ")
    cited = F.array(F.col("doc_id"), F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 7).otherwise(1))
    owned = F.sequence(F.col("doc_id") - 1, F.col("doc_id") + 3)
    return docs.select("doc_id", F.array_join(X.claim_errors(evidence, F.col("text"), answer, cited, owned), ",").alias("errors"))


def _squeezed(x):
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


_add("fn15_substring_gate", fn15, f"""SELECT doc_id, concat_ws(',', CASE WHEN {_squeezed('e')} = '' OR NOT contains({_squeezed('text')}, {_squeezed('e')}) THEN 'evidence' END,
  CASE WHEN least(doc_id % 12, len([x FOR x IN regexp_split_to_array(text, '[ \n]+') IF x <> ''])) NOT BETWEEN 1 AND 8 THEN 'answer_length' END, CASE WHEN doc_id % 5 = 0 THEN 'citation' END) AS errors
FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN reverse(substring(text, 12, 40)) ELSE substring(text, 12, 40) END AS e FROM documents WHERE text IS NOT NULL)""")  # fmt: skip
_add("fn16_leak_predicate", lambda s, d: P.count_patterns(V.turns(s, d).select("attempt", "step", "text"), _aliases(s, d, 1), "text", "alias", "leaks", whole_word=False).drop("text"),
     oracle(TURNS, ALIASES[1], body="SELECT attempt, step, (SELECT count(DISTINCT alias) FROM aliases WHERE contains(lower(turns.text), lower(alias))) AS leaks FROM turns"))
_add("fn17_wording_rules", lambda s, d: V.turns(s, d).select("attempt", "step", F.array_join(F.array_compact(F.array(F.when(F.col("text").rlike("\\d"), F.lit("digit")), F.when(~F.col("text").rlike("[.!?]$"), F.lit("no_end")), F.when(F.length("text") > 300, F.lit("long")))), ",").alias("errors")),
     oracle(TURNS, body="SELECT attempt, step, concat_ws(',', CASE WHEN regexp_matches(text, '[0-9]') THEN 'digit' END, CASE WHEN NOT regexp_matches(text, '[.!?]$') THEN 'no_end' END, CASE WHEN length(text) > 300 THEN 'long' END) AS errors FROM turns"))
_add("fn18_question_text", lambda s, d: V.facts(s, d).select("fact_id", F.format_string("After %s, which %s did user %d take?", F.date_format("start", "yyyy-MM-dd"), F.col("property"), F.col("subject")).alias("question")),
     oracle(FACTS, body="SELECT fact_id, 'After ' || CAST(start AS VARCHAR) || ', which ' || property || ' did user ' || CAST(subject AS VARCHAR) || ' take?' AS question FROM facts"))
_add("fn19_canonical_hash", lambda s, d: V.log(s, d).select("line_no", X.canonical_hash(["model", "case_id", "distance"]).alias("h")),
     oracle(LOG, body="""SELECT line_no, sha256('{"case_id":' || CAST(case_id AS VARCHAR) || ',"distance":' || coalesce(CAST(distance AS VARCHAR), 'null') || ',"model":"' || model || '"}') AS h FROM log"""))
_add("fn20_spaced_hash", lambda s, d: V.log(s, d).select("line_no", F.sha2(F.format_string('{"case_id": %d, "model": "%s"}', "case_id", "model"), 256).alias("h")),
     oracle(LOG, body="""SELECT line_no, sha256('{"case_id": ' || CAST(case_id AS VARCHAR) || ', "model": "' || model || '"}') AS h FROM log"""))
_add("fn21_evidence_id", lambda s, d: V.table(s, d, "pages").select("page_id", F.concat(F.lit("evidence_"), F.substring(F.sha2(F.concat_ws("|", "url", "html"), 256), 1, 24)).alias("evidence_id")), "SELECT page_id, 'evidence_' || substring(sha256(url || '|' || html), 1, 24) AS evidence_id FROM pages")
_add("fn22_frozen_page", lambda s, d: V.anchors(s, d).groupBy("page_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("target")), "|"), 256).alias("links_hash")), oracle(ANCHORS, body="SELECT page_id, sha256(string_agg(target, '|' ORDER BY target)) AS links_hash FROM anchors GROUP BY 1"))
_add("fn24_review_hash", lambda s, d: V.table(s, d, "labels").select("doc_id", X.canonical_hash(["doc_id", "quality"]).alias("h")), """SELECT doc_id, sha256('{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"quality":' || CAST(quality AS VARCHAR) || '}') AS h FROM labels""")
_add("fn25_lenient_json", lambda s, d: V.table(s, d, "events").select("event_id", X.lenient_json(F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```")), "k long").alias("j")).select("event_id", "j.k"), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")


def fn26(s, d):
    w = Window.partitionBy("attempt").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    t = V.turns(s, d).withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    return t.where("before < 400").groupBy("attempt").agg(F.sum(F.least(F.length("text"), 400 - F.col("before"))).cast("long").alias("used"), F.count("*").alias("parts"))


_add("fn26_evidence_budget", fn26, oracle(TURNS, "x AS (SELECT attempt, text, coalesce(sum(length(text)) OVER (PARTITION BY attempt ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM turns)", body="SELECT attempt, CAST(sum(least(length(text), 400 - before)) AS BIGINT) AS used, count(*) AS parts FROM x WHERE before < 400 GROUP BY 1"))
_add("fn27_claim_text", lambda s, d: V.facts(s, d).select("fact_id", F.when(F.col("property") == "click", F.concat(F.lit("item "), F.col("object").cast("string"))).when(F.col("property") == "view", F.date_format("start", "yyyy-MM-dd")).when(F.col("property") == "error", F.col("rank")).alias("shown")),
     oracle(FACTS, body="SELECT fact_id, CASE property WHEN 'click' THEN 'item ' || CAST(object AS VARCHAR) WHEN 'view' THEN CAST(start AS VARCHAR) WHEN 'error' THEN rank END AS shown FROM facts"))


def fn28(s, d):
    """How likely a case's number of correct labels is, if each were even."""
    cases = V.log(s, d).groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "correct").alias("k"))
    return cases.select("case_id", "n", "k", F.round(A.binomial_pmf(F.col("k"), F.col("n")), 9).alias("p"))


_add("fn28_binomial_pmf", fn28, oracle(LOG, "c AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE label = 'correct') AS k FROM log GROUP BY 1)", body="SELECT case_id, n, k, round(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + n * ln(0.5)), 9) AS p FROM c"))
_add("fn29_identity_keys", lambda s, d: V.turns(s, d).where("step <= 3").groupBy("attempt").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "action"))), lambda x: x.action), "|"), 256).alias("identity")),
     oracle(TURNS, body="SELECT attempt, sha256(string_agg(action, '|' ORDER BY step, action)) AS identity FROM turns WHERE step <= 3 GROUP BY 1"))
_add("fn30_action_id", lambda s, d: V.links(s, d).select("source", "target", F.concat(F.lit("follow_"), F.substring(F.sha2(F.to_json(F.struct("source", "target")), 256), 1, 16)).alias("action_id")),
     oracle(V.LINKS, body="""SELECT source, target, 'follow_' || substring(sha256('{"source":' || CAST(source AS VARCHAR) || ',"target":' || CAST(target AS VARCHAR) || '}'), 1, 16) AS action_id FROM links"""))
_add("fn31_precedes", lambda s, d: V.facts(s, d).select("fact_id", X.precedes(F.col("start").cast("string"), F.col("end").cast("string")).alias("before")), oracle(FACTS, body='SELECT fact_id, coalesce(start < "end", false) AS before FROM facts'))
