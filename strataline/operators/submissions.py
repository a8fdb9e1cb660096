"""Validation of structured submissions: claims matched first-fit, evidence owned, supported, in time and composed.

A submitted claim that names a required one is held against it.  The others go,
in order, to the first required claim of the same shape that is still open.  As
"of the same shape" is an equality, the n-th open required claim of a shape gets
the n-th unnamed claim of that shape, so the match is one join by rank and has no
sequential part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.text import squeeze

CLAIM = ("subject", "relation", "object", "event_time", "cited")


def normal(value: Column) -> Column:
    return F.lower(squeeze(F.coalesce(value.cast("string"), F.lit(""))))


def _shape(of: str = "") -> Column:
    return F.struct(*(normal(F.col(f"{of}{c}")).alias(c) for c in CLAIM[:3]))


def match_claims(required: DataFrame, claims: DataFrame) -> DataFrame:
    """required with `claim`, the submitted claim that answers it, or null.

    required: case, pos, claim_id, subject, relation, object, event_time.  claims:
    case, pos, claim_id (null or empty for unnamed ones), subject, relation,
    object, event_time, cited.  Of several claims of one name the last counts; an
    unnamed claim answers one required claim at most.
    """
    named = F.coalesce(F.col("claim_id"), F.lit("")) != ""
    by_name = claims.where(named).groupBy("case", "claim_id").agg(F.max_by(F.struct(*CLAIM), "pos").alias("claim"))
    first = required.join(by_name, ["case", "claim_id"], "left")
    rank = lambda: F.row_number().over(Window.partitionBy("case", "_shape").orderBy("pos"))
    open_ = first.where("claim is null").drop("claim").withColumn("_shape", _shape()).withColumn("_n", rank())
    loose = claims.where(~named).withColumn("_shape", _shape()).withColumn("_n", rank()).select("case", "_shape", "_n", F.struct(*CLAIM).alias("claim"))
    second = open_.join(loose, ["case", "_shape", "_n"], "left").drop("_shape", "_n")
    return first.where("claim is not null").unionByName(second)


def claim_results(matched: DataFrame, cases: DataFrame, evidence: DataFrame, witnesses: DataFrame, decisions: DataFrame) -> DataFrame:
    """matched with shape, ends (subject and object alone), owned, supported, in_time, literal and passed.

    matched: the columns of match_claims and `tail`, whether a claim is the case's
    last one, whose object may be any alias of the answer.  cases: case, answer,
    aliases.  evidence: case, evidence_id, content.  witnesses: case, claim_id,
    evidence_id, which support a claim; decisions: case, claim_id, supported, of a
    judge, for claims without a witness.
    """
    known = matched.join(cases.select("case", "answer", F.transform("aliases", normal).alias("_aliases")), "case")
    objects = F.when(F.col("tail"), F.concat(F.col("_aliases"), F.array(normal(F.col("object"))))).otherwise(F.array(normal(F.col("object"))))
    ends = (normal(F.col("subject")) == normal(F.col("claim.subject"))) & F.array_contains(objects, normal(F.col("claim.object")))
    same = ends & (normal(F.col("relation")) == normal(F.col("claim.relation")))
    cited = known.where("claim is not null").select("case", "claim_id", normal(F.col("answer")).alias("_answer"), F.explode(F.array_distinct("claim.cited")).alias("evidence_id"))
    found = cited.join(evidence.select("case", "evidence_id", F.col("content")), ["case", "evidence_id"], "left").join(witnesses.select("case", "claim_id", "evidence_id").distinct().withColumn("_witness", F.lit(True)), ["case", "claim_id", "evidence_id"], "left")
    said = (F.col("_answer") != "") & F.contains(normal(F.col("content")), F.col("_answer"))
    own = found.groupBy("case", "claim_id").agg(F.bool_and(F.col("content").isNotNull()).alias("owned"), F.bool_or(F.coalesce("_witness", F.lit(False))).alias("_seen"), F.bool_or(F.coalesce(said, F.lit(False))).alias("literal"))
    told = decisions.groupBy("case", "claim_id").agg(F.bool_or("supported").alias("_judged"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = known.join(own, ["case", "claim_id"], "left").join(told, ["case", "claim_id"], "left").withColumns({"shape": yes(same), "ends": yes(ends), "owned": yes(F.col("owned")), "literal": yes(F.col("literal"))})
    rows = rows.withColumn("supported", F.col("shape") & F.col("owned") & (yes(F.col("_seen")) | yes(F.col("_judged")))).withColumn("in_time", F.col("claim").isNotNull() & yes(F.col("event_time").isNull() | F.col("event_time").eqNullSafe(F.col("claim.event_time"))))
    return rows.withColumn("passed", F.col("supported") & F.col("in_time")).drop("_aliases", "_seen", "_judged", "answer")


def validate_submissions(results: DataFrame, cases: DataFrame) -> DataFrame:
    """One row for each case: bridges, acquired, and the seven flags with their conjunction `success`.

    results: of claim_results.  cases: case, answer, aliases, actions_valid.
    Composed: the object of the last required claim before the tail is the tail's
    subject, and the submitted tail agrees with it and with the answer.
    """
    critical, tail = results.where(~F.col("tail")), results.where("tail")
    bridges = critical.groupBy("case").agg(
        F.count("*").alias("bridges"), F.count_if("passed").alias("acquired"), F.bool_and("passed").alias("complete"), F.bool_and("in_time").alias("temporal"), F.max_by(normal(F.col("object")), "pos").alias("_bridge"),
    )
    ends = tail.select("case", F.col("passed").alias("tail_passed"), "literal", "ends", normal(F.col("subject")).alias("_subject"))
    right = F.array_contains(F.transform("aliases", normal), normal(F.col("answer")))
    joined = cases.select("case", "actions_valid", right.alias("answer_correct")).join(bridges, "case", "left").join(ends, "case", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    composed = F.coalesce((F.col("_bridge") == F.col("_subject")) & F.col("ends") & F.col("answer_correct"), F.lit(False))
    flags = joined.select("case", F.coalesce("bridges", F.lit(0)).alias("bridges"), F.coalesce("acquired", F.lit(0)).alias("acquired"), no("actions_valid"), no("answer_correct"), no("literal"), no("complete"), no("tail_passed"), no("temporal"), composed.alias("composed"))
    every = ["actions_valid", "answer_correct", "literal", "complete", "tail_passed", "temporal", "composed"]
    together = F.lit(True)
    for c in every:
        together &= F.col(c)
    return flags.withColumn("success", together)
