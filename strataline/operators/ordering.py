"""Order-sensitive operators: dedupe, sampling, top-k and scores with total tie-breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`: a partial aggregate, no window over a hot key."""
    rest = [c for c in rows.columns if c not in keys]
    got = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return got.select(*keys, "_row.*")


def last_wins(rows: DataFrame, keys: list[str], line_no: str) -> DataFrame:
    """The last row of each key by line number."""
    rest = [c for c in rows.columns if c not in keys]
    got = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(line_no)).alias("_row"))
    return got.select(*keys, "_row.*")


def best_score(rows: DataFrame, keys: list[str], score: Column, tie: Column) -> DataFrame:
    """The row of the highest score of each key; the smallest tie value decides."""
    rest = [c for c in rows.columns if c not in keys]
    scored = rows.withColumn("_order", F.struct((-score).alias("s"), tie.alias("t")))
    got = scored.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("_order")).alias("_row"))
    return got.select(*keys, "_row.*")


def even_sample(values: DataFrame, keys: list[str], value: str, limit: int) -> DataFrame:
    """Of the sorted distinct values of each key, those at round(i * (n - 1) / (limit - 1)); a limit of one keeps the last."""
    w = Window.partitionBy(*keys)
    numbered = values.select(*keys, value).distinct().withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    if limit == 1:
        keep = F.col("_i") == F.col("_n") - 1
    else:
        picks = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / F.lit(float(limit - 1))).cast("int"))
        keep = (F.col("_n") <= limit) | F.array_contains(picks, F.col("_i"))
    return numbered.where(keep).select(*keys, value)


def round_robin(rows: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """One row of each group per lap, groups in sorted order, up to `limit`; adds `lap`."""
    lap = (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long")
    return rows.withColumn("lap", lap).where(F.col("lap") < limit).orderBy("lap", group).limit(limit)


def ranked(rows: DataFrame, keys: list[str], order: Sequence, name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(value).over(w))


def log_softmax(rows: DataFrame, keys: list[str], score: Column, name: str) -> DataFrame:
    """score - max - ln(sum(exp(score - max))) within each key."""
    w = Window.partitionBy(*keys)
    shifted = rows.withColumn("_s", score - F.max(score).over(w))
    return shifted.withColumn(name, F.col("_s") - F.ln(F.sum(F.exp("_s")).over(w))).drop("_s")


def ordered_progress(steps: DataFrame, key: str, order: str, value: str, route: Sequence[str]) -> DataFrame:
    """How many values of the route each key meets in order, by a fold over its ordered steps."""
    want = F.array(*map(F.lit, route))
    trace = steps.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("_trace"))
    reached = F.aggregate("_trace", F.lit(0), lambda n, x: F.when((n < len(route)) & (F.get(want, n) == x), n + 1).otherwise(n))
    return trace.select(key, reached.alias("reached"))


def stratified(rows: DataFrame, stratum: Column, order: Sequence, total: int, strata: int) -> DataFrame:
    """`total` rows split over strata 0.. evenly, the first ones taking the remainder."""
    each, rest = divmod(total, strata)
    named = rows.withColumn("stratum", stratum).where(F.col("stratum").between(0, strata - 1))
    quota = each + F.when(F.col("stratum") < rest, 1).otherwise(0)
    return ranked(named, ["stratum"], order, "_rn").where(F.col("_rn") <= quota).drop("_rn")


def document_order(rows: DataFrame, keys: list[str], content: str, token: Column, pos: str) -> DataFrame:
    """Place of each row by where its token stands in the content; absent tokens follow in input order."""
    at = F.instr(F.col(content), token)
    return ranked(rows.withColumn("_at", F.when(at == 0, F.length(content) + F.col(pos)).otherwise(at)), keys, ["_at", pos], "place").drop("_at")


def round_schedules(groups: DataFrame, key: str, items: str, rounds: str, distractor_every: int, seed: str) -> DataFrame:
    """(key, round_no, item): rounds 1..n of every group, laps over its items in an order seeded by key and lap, a distractor at every k-th round.

    groups: key, an array of items and a number of rounds.  A group without items
    has distractors alone; distractor_every 0 means none.
    """
    slots = groups.where(F.col(rounds) > 0).select(F.col(key).alias("_key"), F.array_distinct(F.coalesce(F.col(items).cast("array<string>"), F.array().cast("array<string>"))).alias("_items"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(rounds).cast("long"))).alias("round_no"))
    away = (F.col("round_no") % distractor_every == 0) if distractor_every else F.lit(False)
    i = F.col("round_no") - 1 - (F.floor((F.col("round_no") - 1) / distractor_every) if distractor_every else 0)
    n = F.size("_items")
    lap = F.floor(i / F.greatest(n, F.lit(1)))
    keyed = F.array_sort(F.transform("_items", lambda x: F.struct(F.sha2(F.concat_ws("|", F.lit(seed), F.col("_key").cast("string"), lap.cast("string"), x), 256).alias("h"), x.alias("x"))))
    item = F.get(keyed, (i % F.greatest(n, F.lit(1))).cast("int"))["x"]
    return slots.select(F.col("_key").alias(key), "round_no", F.when(away | (n == 0), F.lit("distractor")).otherwise(item).alias("item"))


def top_k(rows: DataFrame, score: Column, identity: Column, seed: str, k: int) -> DataFrame:
    """The k best scores; ties go by SHA-256 of seed and identity, so the order is total."""
    return rows.orderBy(score.desc(), F.sha2(F.concat(F.lit(f"{seed}|"), identity.cast("string")), 256)).limit(k)


def hash_pick(n: Column, text: Column) -> Column:
    """Index below n from the first eight bytes of SHA-256 of a text."""
    head = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % n.cast("decimal(20,0)")).cast("long")


def capped(rows: DataFrame, parent: str, order: Sequence, each: int, total: int) -> DataFrame:
    """The first `each` rows of every parent, then the first `total` of them over parents in order."""
    own = ranked(rows, [parent], order, "_rn").where(F.col("_rn") <= each)
    return own.orderBy(parent, "_rn").limit(total).drop("_rn")


def until_target(rows: DataFrame, order: str, counts: Column, target: int) -> DataFrame:
    """Rows up to the one, by `order`, with which `target` rows have counted; all rows if fewer do.

    The place of the cut is the greatest of the `target` first counting rows, so
    no task adds up all rows in order.
    """
    first = rows.where(counts).select(F.col(order).alias("_order")).orderBy("_order").limit(target).agg(F.count("*").alias("_n"), F.max("_order").alias("_cut"))
    return rows.join(F.broadcast(first)).where((F.col("_n") < target) | (F.col(order) <= F.col("_cut"))).drop("_n", "_cut")
