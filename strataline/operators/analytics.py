"""Log analytics: cells, transitions, tests, intervals and admission."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one place, half to even; null on zero."""
    return F.when(whole > 0, F.bround(100 * part / whole, 1))


def cells(rows: DataFrame, keys: list[str], correct: Column) -> DataFrame:
    """successes and n by key; a null key value is a group of its own."""
    return rows.groupBy(*keys).agg(F.sum(correct.cast("long")).alias("successes"), F.count("*").alias("n"))


def half_life(cells_: DataFrame, keys: list[str], occurrence: str = "occurrence") -> DataFrame:
    """First occurrence with less than half correct, else '>' and the last occurrence."""
    g = cells_.groupBy(*keys).agg(F.min(F.when(2 * F.col("successes") < F.col("n"), F.col(occurrence))).alias("_first"), F.max(occurrence).alias("_last"))
    return g.select(*keys, F.coalesce(F.col("_first").cast("string"), F.concat(F.lit(">"), F.col("_last").cast("string"))).alias("half_life"))


def radius(cells_: DataFrame, keys: list[str], occurrence: int, threshold: int) -> DataFrame:
    """Greatest distance with at least `threshold` percent correct at one occurrence; 0 without one."""
    ok = (F.col("occurrence") == occurrence) & (100 * F.col("successes") >= threshold * F.col("n"))
    return cells_.groupBy(*keys).agg(F.coalesce(F.max(F.when(ok, F.col("distance"))), F.lit(0)).alias("radius"))


def paired_transitions(rows: DataFrame, keys: list[str], occurrence: str, correct: str, line_no: str) -> DataFrame:
    """Adjacent occurrences of each key, the last row of an occurrence counting: (keys, kind)."""
    last = rows.groupBy(*keys, occurrence).agg(F.max_by(correct, line_no).alias("_c"))
    after = F.lead("_c").over(Window.partitionBy(*keys).orderBy(occurrence))
    kind = F.when(F.col("_c") & F.col("_n"), "stable_correct").when(F.col("_c"), "reversion").when(F.col("_n"), "recovery").otherwise("stable_wrong")
    return last.withColumn("_n", after).where("_n is not null").select(*keys, kind.alias("kind"))


def binomial_pmf(k: Column, n: Column, p: float = 0.5) -> Column:
    """comb(n, k) p^k (1 - p)^(n - k) by a product over 1..k, of more than 1,000 trials by a sum of logarithms."""
    steps = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    comb = F.aggregate(steps, F.lit(1.0), lambda x, i: x * (n - k + i) / i)
    product = comb * F.pow(F.lit(p), k) * F.pow(F.lit(1 - p), n - k)
    if not 0 < p < 1:
        return F.when((k == n) if p else (k == 0), 1.0).otherwise(0.0)
    # the coefficient overflows at 1,030 trials, the powers vanish soon after
    logs = F.aggregate(steps, (n - k) * F.log(F.lit(1 - p)), lambda x, i: x + F.log((n - k + i) / i * p))
    return F.when(n <= 1000, product).otherwise(F.exp(logs))


def mcnemar(reversion: Column, recovery: Column) -> Column:
    """Two-sided exact p of the discordant pairs: the sum of pmf values not above that of the smaller count.

    The values of one side are walked from the middle outwards by their ratios,
    so none overflows at any number of pairs, and the others are their mirror images.
    """
    n = (reversion + recovery).cast("int")
    half, least = F.floor(n / 2).cast("int"), F.least(reversion, recovery)
    # comb(n, half) / 2^n, where an odd n has the middle value of n + 1
    middle = F.aggregate(F.sequence(F.lit(1), n - half), F.lit(1.0), lambda x, i: x * (2 * i - 1) / (2 * i))
    start = F.struct(middle.alias("pmf"), middle.alias("own"))
    own = F.aggregate(F.sequence(half, F.lit(0)), start, lambda s, k: F.struct((s.pmf * k / (n - k + 1)).alias("pmf"), F.when(k == least, s.pmf).otherwise(s.own).alias("own"))).own
    start = F.struct(middle.alias("pmf"), F.lit(0.0).alias("total"), own.alias("own"))

    def step(s: Column, k: Column) -> Column:
        counted = F.when(s.pmf <= s.own + 1e-12, F.when(2 * k == n, s.pmf).otherwise(2 * s.pmf)).otherwise(0.0)
        return F.struct((s.pmf * k / (n - k + 1)).alias("pmf"), (s.total + counted).alias("total"), s.own.alias("own"))

    return F.when(n > 0, F.least(F.aggregate(F.sequence(half, F.lit(0)), start, step).total, F.lit(1.0)))


def bootstrap(cells_: DataFrame, keys: list[str], draws: int = 2000, seed: int = 0) -> DataFrame:
    """Interval of each cell's percentage from `draws` binomial resamples, seeded by the key.

    The bounds are the elements 0.025 * draws and 0.975 * draws of the sorted values.
    """
    lo, hi = int(0.025 * draws), int(0.975 * draws)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for p in parts:
            low, high = [], []
            for s, n, h in zip(p.successes, p.n, p["_h"]):
                if not n:
                    low.append(None)
                    high.append(None)
                    continue
                x = np.sort(np.random.RandomState((int(h) ^ seed) % (1 << 32)).binomial(n, s / n, draws)) * 100.0 / n
                low.append(round(float(x[lo]), 1))
                high.append(round(float(x[hi]), 1))
            yield p.drop(columns="_h").assign(low=low, high=high)

    fields = ", ".join(f"{k} {t}" for k, t in cells_.dtypes)
    return cells_.withColumn("_h", F.xxhash64(*keys)).mapInPandas(run, f"{fields}, low double, high double")


def bootstrap_difference(pairs: DataFrame, keys: list[str], draws: int = 2000, seed: int = 0) -> DataFrame:
    """Interval of the difference of two resampled percentages (a - b), and whether it lies below zero.

    pairs: keys, a_successes, a_n, b_successes, b_n.
    """
    lo, hi = int(0.025 * draws), int(0.975 * draws)

    def run(parts):
        import numpy as np

        for p in parts:
            out = []
            for a, m, b, n, h in zip(p.a_successes, p.a_n, p.b_successes, p.b_n, p["_h"]):
                if not m or not n:
                    out.append((None, None, None))
                    continue
                r = np.random.RandomState((int(h) ^ seed) % (1 << 32))
                x = np.sort(100.0 * (r.binomial(m, a / m, draws) / m - r.binomial(n, b / n, draws) / n))
                out.append((round(float(x[lo]), 1), round(float(x[hi]), 1), bool(x[hi] < 0)))
            yield p.drop(columns="_h").assign(low=[x[0] for x in out], high=[x[1] for x in out], significant=[x[2] for x in out])

    fields = ", ".join(f"{k} {t}" for k, t in pairs.dtypes)
    return pairs.withColumn("_h", F.xxhash64(*keys)).mapInPandas(run, f"{fields}, low double, high double, significant boolean")


def admission(probes: DataFrame, case: list[str], probe: str, known: Column, judgeable: Column, primary: Column, most: float) -> DataFrame:
    """Factorised admission: every probe judgeable, and every primary probe known at most `most` of the time."""
    each = probes.groupBy(*case, probe).agg(F.sum(known.cast("long")).alias("known"), F.count("*").alias("n"), F.bool_and(judgeable).alias("_ok"), F.bool_or(primary).alias("_primary"))
    ok = F.col("_ok") & (~F.col("_primary") | (F.col("known") <= most * F.col("n")))
    return each.groupBy(*case).agg(F.bool_and(ok).alias("admitted"), F.count("*").alias("probes"), F.sum("known").alias("known"))


def grouping_counts(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts by each dimension alone, in one pass of grouping sets: (dimension, value, n)."""
    names = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in dimensions])
    values = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c).cast("string")) for c in dimensions])
    return rows.groupingSets([[c] for c in dimensions], *dimensions).agg(names.alias("dimension"), values.alias("value"), F.count("*").alias("n")).select("dimension", "value", "n")


def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    return rows.groupBy(expected, predicted).agg(F.count("*").alias("n"))
