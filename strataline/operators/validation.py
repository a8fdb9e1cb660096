"""Constraint operators: every check adds to an array of errors, none raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def errors(*checks: tuple[str, Column]) -> Column:
    """Names of the checks whose condition holds; an unknown condition counts as an error."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks]))


def certificate(events: DataFrame, keys: list[str], date: str, target: str, boundary: Column, coverage: Column) -> DataFrame:
    """Sorted distinct candidates in (boundary, coverage] of each key, their digest and the selection.

    The selection is the target of the earliest date if it is the only one there.
    """
    inside = events.where((F.col(date) > boundary) & (F.col(date) <= coverage)).select(*keys, date, target).distinct()
    got = inside.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(date, target))).alias("candidates"))
    first = F.filter("candidates", lambda c: c[date] == F.col("candidates")[0][date])
    text = F.array_join(F.transform("candidates", lambda c: F.concat_ws("|", c[date].cast("string"), c[target].cast("string"))), ";")
    return got.select(*keys, "candidates", F.when(F.size(first) == 1, first[0][target]).alias("selected"), first[0][date].alias("selected_date"), F.sha2(text, 256).alias("digest"))


def certificate_errors(date: str, target: str, boundary: Column, expected: Column) -> Column:
    dates = F.transform("candidates", lambda c: c[date])
    return errors(
        ("empty", F.size("candidates") == 0), ("before_boundary", F.array_min(dates) <= boundary), ("unsorted", F.array_sort(dates) != dates),
        ("duplicates", F.size(F.array_distinct("candidates")) != F.size("candidates")), ("ambiguous", F.col("selected").isNull()), ("unexpected", F.col("selected") != expected),
    )


def chain_errors(hops: DataFrame, chain: str, order: str, source: str, target: str, date: str) -> DataFrame:
    """Per chain: hops that do not join, dates that do not advance, repeated edges."""
    w = Window.partitionBy(chain).orderBy(order)
    prior = hops.withColumn("_t", F.lag(target).over(w)).withColumn("_d", F.lag(date).over(w)).withColumn("_e", F.row_number().over(Window.partitionBy(chain, source, target).orderBy(order)))
    flags = prior.groupBy(chain).agg(F.bool_or(F.col("_t").isNotNull() & (F.col("_t") != F.col(source))).alias("a"), F.bool_or(F.col("_d").isNotNull() & (F.col("_d") >= F.col(date))).alias("b"), F.bool_or(F.col("_e") > 1).alias("c"), F.count("*").alias("hops"))
    return flags.select(chain, "hops", errors(("disconnected", F.col("a")), ("date_order", F.col("b")), ("repeated_edge", F.col("c"))).alias("errors"))


def set_equal(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)))


def manifest_mismatch(found: DataFrame, manifest: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys that are missing, unexpected or differ."""
    both = found.select(key, F.col(digest).alias("_f")).join(manifest.select(key, F.col(digest).alias("_m")), key, "full")
    state = F.when(F.col("_f").isNull(), "missing").when(F.col("_m").isNull(), "unexpected").when(F.col("_f") != F.col("_m"), "differs")
    return both.select(key, state.alias("state")).where("state is not null")


def sentence_errors(text: Column, least: Column, most_words: int) -> Column:
    clean = F.transform(F.split(text, "[.!?]+"), lambda x: F.trim(F.regexp_replace(x, "\\s+", " ")))
    sentences = F.filter(clean, lambda x: x != "")
    long_ = F.exists(sentences, lambda x: F.size(F.split(x, " ")) > most_words)
    return errors(("few_sentences", F.size(sentences) < least), ("long_sentence", long_))


def all_checks(checks: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(F.col(c), F.lit(False))
    return out
