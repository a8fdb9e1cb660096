"""Temporal operators: interval predicates, selection policies, next events, as-of joins.

All dates are typed columns and predicates stay sargable.  Where a date has
several distinct targets the answer is nothing, never an arbitrary row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holds_at(start: Column, end: Column, at: Column) -> Column:
    """Both bounds inclusive, an absent bound is open."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (end >= at))


def holds_since_start(starts: Column, ends: Column, at: Column) -> Column:
    """Over arrays of qualifiers: the earliest start is required, an absent latest end is open."""
    return F.coalesce(F.array_min(starts) <= at, F.lit(False)) & (F.array_max(ends).isNull() | (F.array_max(ends) >= at))


def current_claim(start: Column, end: Column, rank: Column, at: Column, active_only: bool = True) -> Column:
    """As holds_at, but a claim without bounds must be preferred; without active_only the end is not looked at."""
    bounded = start.isNotNull() | end.isNotNull() | (rank == "preferred")
    ends = (end.isNull() | (end >= at)) if active_only else F.lit(True)
    return bounded & (start.isNull() | (start <= at)) & ends


def preferred_rank(claims: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """Drops deprecated claims; keys that have a preferred claim keep only those."""
    some = F.max((F.col(rank) == "preferred").cast("int")).over(Window.partitionBy(*keys))
    live = claims.where(F.col(rank) != "deprecated").withColumn("_some", some)
    return live.where((F.col("_some") == 0) | (F.col(rank) == "preferred")).drop("_some")


def in_window(column: Column, after: Column, until: Column) -> Column:
    """after < column <= until."""
    return (column > after) & (column <= until)


def stable_claim(start: Column, end: Column, now: Column, years: int) -> Column:
    return end.isNull() & (F.datediff(now, start) >= years * 365)


def first_unique(events: DataFrame, keys: list[str], date: str, target: str) -> DataFrame:
    """Earliest date of each key with its only target; keys with several targets on that date give nothing."""
    first = events.where(F.col(date).isNotNull()).groupBy(*keys, date).agg(F.min(target).alias(target), F.max(target).alias("_last"))
    least = first.groupBy(*keys).agg(F.min_by(F.struct(date, target, "_last"), date).alias("_first"))
    return least.where(F.col(f"_first.{target}") == F.col("_first._last")).select(*keys, F.col(f"_first.{date}").alias(date), F.col(f"_first.{target}").alias(target))


def next_unique(events: DataFrame, keys: list[str], date: str, target: str, previous: str) -> DataFrame:
    """Next event with a target other than `previous`; an ambiguous date met first gives nothing.

    Dates whose only target is the previous one are passed over.
    """
    days = events.groupBy(*keys, previous, date).agg(F.min(target).alias("_one"), F.max(target).alias("_two"))
    clear = F.col("_one") == F.col("_two")
    picked = days.groupBy(*keys, previous).agg(
        F.min(F.when(~clear, F.col(date))).alias("_stop"),
        F.min(F.when(clear & ~F.col("_one").eqNullSafe(F.col(previous)), F.struct(F.col(date), F.col("_one").alias(target)))).alias("_next"),
    )
    ok = F.col("_next").isNotNull() & (F.col("_stop").isNull() | (F.col(f"_next.{date}") < F.col("_stop")))
    return picked.where(ok).select(*keys, previous, F.col(f"_next.{date}").alias(date), F.col(f"_next.{target}").alias(target))


def latest_by(claims: DataFrame, keys: list[str], date: str, target: str) -> DataFrame:
    """Target of the latest date of each key, where the claims of that date agree."""
    days = claims.where(F.col(date).isNotNull()).groupBy(*keys, date).agg(F.min(target).alias("_one"), F.max(target).alias("_two"))
    last = days.groupBy(*keys).agg(F.max_by(F.struct(date, "_one", "_two"), date).alias("_last"))
    return last.where("_last._one = _last._two").select(*keys, F.col(f"_last.{date}").alias(date), F.col("_last._one").alias(target))


def single_target(claims: DataFrame, keys: list[str], target: str) -> DataFrame:
    """The target of keys with exactly one distinct target."""
    got = claims.groupBy(*keys).agg(F.min(target).alias(target), F.max(target).alias("_two"))
    return got.where(F.col(target) == F.col("_two")).drop("_two")


def successor_transitions(rows: DataFrame, key: str, holder: str, order: list[str]) -> DataFrame:
    """Consecutive rows of a key where the holder changes: (key, from, to, and the order columns of the later row)."""
    w = Window.partitionBy(key).orderBy(*order)
    later = rows.select(key, F.lag(holder).over(w).alias("from_holder"), F.col(holder).alias("to_holder"), *order)
    return later.where("from_holder is not null and from_holder <> to_holder")


def as_of(points: DataFrame, versions: DataFrame, key: str, at: str, ts: str, tie: str, days: int = 32) -> DataFrame:
    """Each point with the last version of its key with ts <= at, or nulls where there is none.

    The two sides are put in one sequence for each key and stretch of `days`
    days, in time order, and the version is carried forward; a point before the
    first version of its stretch takes the last version of an earlier one, of
    which there is one for each key and stretch.  So a key with many versions
    is spread over its stretches, both sides are shuffled once, and there is no
    range join.  Points keep all their columns; version columns come as a struct
    `version`.  Versions without a key or time belong to no point, and a point
    without one has no version.  Of equal times the greatest `tie` is the last.
    """
    stretch = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / (days * 86_400))
    kind = versions.schema
    left = points.select(F.col(key).alias("_key"), F.col(at).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(kind[tie].dataType).alias("_tie"), F.struct(*points.columns).alias("_point"), F.lit(None).cast(kind).alias("_version"))
    known = versions.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    right = known.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(points.schema).alias("_point"), F.struct(*versions.columns).alias("_version"))
    sequence = left.unionByName(right).withColumn("_stretch", stretch(F.col("_ts")))
    inside = Window.partitionBy("_key", "_stretch").orderBy("_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = sequence.withColumn("version", F.last("_version", ignorenulls=True).over(inside)).where("_side = 1")
    # the last version of each stretch, and the stretches that points ask for
    ends = right.select("_key", stretch(F.col("_ts")).alias("_stretch"), "_ts", "_tie", "_version").groupBy("_key", "_stretch").agg(F.max_by("_version", F.struct("_ts", "_tie")).alias("_end"))
    asked = left.where("_key is not null and _ts is not null").select("_key", stretch(F.col("_ts")).alias("_stretch")).distinct().withColumn("_end", F.lit(None).cast(kind))
    before = Window.partitionBy("_key").orderBy("_stretch").rangeBetween(Window.unboundedPreceding, -1)
    earlier = ends.withColumn("_asks", F.lit(False)).unionByName(asked.withColumn("_asks", F.lit(True))).withColumn("_earlier", F.last("_end", ignorenulls=True).over(before))
    earlier = earlier.where(F.col("_asks") & F.col("_earlier").isNotNull()).select("_key", "_stretch", "_earlier")
    found = carried.join(earlier, ["_key", "_stretch"], "left")
    return found.select("_point.*", F.coalesce("version", "_earlier").alias("version"))


def end_of_day(date: Column) -> Column:
    """A bare date stands for 23:59:59 UTC of its day."""
    return F.to_timestamp(date) + F.expr("interval '23:59:59' hour to second")


def time_buckets(since: Column, until: Column, count: int) -> Column:
    """Non-overlapping day ranges that cover [since, until]: array of (bucket, first, last)."""
    days = F.datediff(until, since) + 1
    cut = lambda k: F.date_add(since, F.floor(days * k / count).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.struct(k.alias("bucket"), cut(k).alias("first"), F.date_sub(cut(k + 1), 1).alias("last")))
