"""Label, outcome and gate expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.operators.patterns import find_patterns


def similar_popularity(a: Column, b: Column, percent: int) -> Column:
    """|a - b| within a percentage of the larger; unknown values and two zeros pass."""
    near = (F.greatest(a, b) == 0) | (F.abs(a - b) * 100 <= percent * F.greatest(a, b))
    return a.isNull() | b.isNull() | near


def public_fields(rows: DataFrame, public: Sequence[str], private: Sequence[str]) -> DataFrame:
    """The public columns; a public name that is private or unknown is an error."""
    wrong = [c for c in public if c in private or c not in rows.columns]
    if wrong:
        raise ValueError(f"not public fields: {', '.join(wrong)}")
    return rows.select(*public)


def leaks(texts: DataFrame, secrets: DataFrame, key: str, text: str, secret_key: str, secret: str) -> DataFrame:
    """(key, secret_key) where a text contains a secret literally, without regard to case."""
    return find_patterns(texts, secrets, [key], text, secret_key, secret, whole_word=False).select(key, secret_key)


def failure_mode(label: Column, unsubmitted: Column, unreached: Column, evidence: Column) -> Column:
    """The first that applies, from success to a wrong answer."""
    return (
        F.when((label == "stick_new") & evidence, "success").when(label == "stick_new", "right_without_evidence")
        .when(unsubmitted, "not_submitted").when(unreached, "target_not_reached").when(label == "stick_old", "prior_reversion")
        .when(label == "correct", "partial").otherwise("wrong_answer")
    )


def recommendation(sampled: Column, checked: Column, supported: Column, samples: int, checks: int, support: int, rate: float) -> Column:
    return (
        F.when(sampled == 0, "no_samples").when(sampled < samples, "few_samples").when(checked == 0, "unchecked").when(checked < checks, "few_checks")
        .when(supported == 0, "unsupported").when(supported < support, "few_supported").when(supported / checked < rate, "low_rate").otherwise("admit")
    )


def keyword_label(text: Column, old: Sequence[str], new: Sequence[str], hedges: Sequence[str]) -> Column:
    """New keywords come before old ones, old ones before hedges."""
    has = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(text), w))
    return F.when(has(new), "stick_new").when(has(old), "stick_old").when(has(hedges), "hedge").otherwise("other")


def transition_label(previous: Column, current: Column) -> Column:
    return (
        F.when(previous.isNull(), "initial").when((previous == "stick_new") & (current == "stick_old"), "reversion")
        .when((previous == "stick_old") & (current == "stick_new"), "recovery").when(previous == current, F.concat(F.lit("stable_"), current))
        .otherwise(F.concat(previous, F.lit("_to_"), current))
    )


def has_marker(texts: Column, markers: Sequence[str]) -> Column:
    return F.exists(texts, lambda t: F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(t), m)))


def authorisation(controller: Column, method: Column, admitted: Column, least: int) -> Column:
    """The reasons against, none if all gates are open."""
    return F.array_compact(F.array(F.when(~controller, "controller_gate"), F.when(~method, "method_gate"), F.when(admitted < least, "admitted_cases")))
