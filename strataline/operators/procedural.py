"""Operators whose semantics are sequential: picks one after the other over rows of any number, walks and replays of bounded runs.

Randomness comes from hashes of seed, group and step.
"""

from __future__ import annotations

import difflib
import hashlib
import html
import math
import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strataline.operators.staging import settle

_TAG = re.compile(r"<!--.*?-->|<(script|style|sup|figure|nav|noscript)\b.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>", re.S | re.I)
_HREF = re.compile(r"""href\s*=\s*["']([^"']*)["']""", re.I)
_KEPT = frozenset("p li h1 h2 h3 h4 h5 h6 dd dt caption th td".split())


def uniform(*parts: object) -> float:
    """A number in [0, 1) from the SHA-256 of the parts."""
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16.0**13


def page_blocks(text: str | None) -> tuple[str, list[dict]]:
    """Content blocks joined by blank lines, and the links inside them in order."""
    blocks, links, depth, at = [], [], 0, 0
    block: list[str] = []
    anchor: list | None = None
    for m in _TAG.finditer(text or ""):
        if depth:
            piece = (text or "")[at : m.start()]
            block.append(piece)
            if anchor is not None:
                anchor[1].append(piece)
        at = m.end()
        name = (m[3] or "").lower()
        if name in _KEPT:
            if depth:
                done = " ".join(html.unescape("".join(block)).split())
                if done:
                    blocks.append(done)
            block, depth = [], 0 if m[2] else 1
        elif name == "a" and depth:
            if m[2] and anchor is not None:
                links.append({"target": anchor[0], "anchor": " ".join(html.unescape("".join(anchor[1])).split())})
                anchor = None
            elif not m[2] and (h := _HREF.search(m[4])):
                anchor = [html.unescape(h[1]).lstrip("/"), []]
        elif name == "br" and depth:
            block.append(" ")
    return "\n\n".join(blocks), links


def _parse_pages(pages: pd.Series) -> pd.DataFrame:
    got = [page_blocks(x) for x in pages]
    return pd.DataFrame({"content": [x[0] for x in got], "links": [x[1] for x in got]})


def parse_page(page: Column | str) -> Column:
    """Content and links of a rendered page."""
    return F.pandas_udf(_parse_pages, "struct<content:string,links:array<struct<target:string,anchor:string>>>")(page)


def block_diff(before: str | None, after: str | None, changed: int = 24, stable: int = 16) -> tuple[list[str], list[str], list[str]]:
    """Removed, added and stable blocks by matching block runs, in order, each list capped."""
    a, b = ((t or "").split("\n\n") for t in (before, after))
    removed, added, same = [], [], []
    for op, i, j, k, l in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            same += a[i:j]
        else:
            removed += a[i:j]
            added += b[k:l]
    return removed[:changed], added[:changed], same[:stable]


def _diffs(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dict(zip(("removed", "added", "stable"), block_diff(x, y))) for x, y in zip(before, after)], columns=["removed", "added", "stable"])


def revision_diff(before: Column | str, after: Column | str) -> Column:
    """Removed, added and stable blocks of two texts."""
    return F.pandas_udf(_diffs, "struct<removed:array<string>,added:array<string>,stable:array<string>>")(before, after)


def greedy_pool(rows: DataFrame, total: int, per_cell: int, order: list[str], keys: tuple[str, str, str] = ("family", "property", "source")) -> DataFrame:
    """The rows that a greedy pick of `total` can take, if it takes greater values of `order` first within equal (family, property, source).

    per_cell: how many rows the caps allow of one (family, property, source).
    Exact: a row is taken before a better one of its family and property only if
    the better one's source is used, and at most `total` sources are; so are the
    bounds for a family and source, and for a family.  The pool is bounded by the
    parameters for each family, whatever the number of rows.
    """
    family, prop, source = keys
    pair = total * per_cell + 1
    for by, most in (([family, prop, source], per_cell), ([family, prop], pair), ([family, source], pair), ([family], 2 * total * pair + 1)):
        w = Window.partitionBy(*by).orderBy(*(F.desc_nulls_last(c) for c in order))
        rows = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")
    return rows


def greedy_pick(rows: DataFrame, total: int, caps: dict[str, int], order: Callable[[Callable[[str], Column]], list[Column]]) -> DataFrame:
    """rows picked one after the other, with their place: `total` at most, each the first by `order` among those whose capped values are not used up.

    order gets a function that tells how often the value of a column was picked
    so far, and returns descending sort columns that end in a unique one, `id`.
    Every pick is one pass over the rows with a partial maximum in each task;
    the driver holds what was picked and nothing else, so neither rows nor
    families are limited.
    """
    rows = settle(rows, "pool")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))  # noqa: E731  a null is a value like others
    kind, out = rows.schema, []
    used: dict[str, dict[str, int]] = {c: {} for c in rows.columns}

    def count(c: str) -> Column:
        known = [F.lit(x) for pair in used[c].items() for x in pair]
        return F.coalesce(F.create_map(*known)[name(c)], F.lit(0)) if known else F.lit(0)

    while len(out) < total:
        open_ = rows.where(~F.col("id").isin([r["id"] for r in out])) if out else rows
        for c, most in caps.items():
            if full := [v for v, n in used[c].items() if n >= most]:
                open_ = open_.where(~name(c).isin(full))
        best = open_.orderBy(*order(count)).limit(1).collect()
        if not best:
            break
        out.append(best[0])
        for c in used:
            v = "\0" if best[0][c] is None else _as_text(best[0][c])
            used[c][v] = used[c].get(v, 0) + 1
    return _placed(rows, kind, out)


def _as_text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _placed(rows: DataFrame, kind, out: list) -> DataFrame:
    return rows.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(out)], StructType([*kind.fields, StructField("place", LongType())]))


def by_popularity(count: Callable[[str], Column]) -> list[Column]:
    """The greatest ln(max(1, views) + 1) / (1 + 2 f + p + s); ties go to more views, then to the greatest id."""
    score = F.log1p(F.greatest(F.lit(1), "views").cast("double")) / (1 + 2 * count("family") + count("property") + count("source"))
    return [score.desc(), F.desc("views"), F.desc("id")]


def by_coverage(count: Callable[[str], Column]) -> list[Column]:
    """New families, then new properties, then the score, then the greatest id."""
    return [(count("family") == 0).desc(), (count("property") == 0).desc(), F.desc("score"), F.desc("id")]


def capped_round_robin(rows: DataFrame, total: int, lane: str, caps: dict[str, int]) -> DataFrame:
    """rows picked lap by lap, one of each lane in the order of lanes, the least id whose capped values are not used up; with their place."""
    rows, out, at, moved = settle(rows, "pool"), [], None, False
    kind, used = rows.schema, {c: {} for c in caps}
    while len(out) < total:
        open_ = rows.where(~F.col("id").isin([r["id"] for r in out])) if out else rows
        for c, most in caps.items():
            if full := [v for v, n in used[c].items() if n >= most]:
                open_ = open_.where(F.col(c).isNull() | ~F.col(c).isin(full))
        next_ = (open_ if at is None else open_.where(F.col(lane) > at)).where(F.col(lane).isNotNull()).orderBy(lane, "id").limit(1).collect()
        if next_:
            out.append(next_[0])
            at, moved = next_[0][lane], True
            for c in caps:
                used[c][next_[0][c]] = used[c].get(next_[0][c], 0) + 1
        elif not moved:
            break
        else:  # the next lap
            at, moved = None, False
    return _placed(rows, kind, out)


def pheromones(steps: pd.DataFrame, evaporation: float = 0.15, low: float = 0.05, high: float = 5.0, tail: int = 4) -> pd.DataFrame:
    """Levels of each edge after replaying one run's steps in order.

    Every step evaporates all edges.  A positive reward is laid on the last
    `tail` edges, less with distance; a negative one on the chosen edge alone.
    """
    level: dict = {}
    trail: list = []
    for edge, reward in steps.sort_values("step")[["edge", "reward"]].itertuples(index=False):
        trail.append(edge)
        level.setdefault(edge, 1.0)
        for e in level:
            level[e] = max(low, level[e] * (1 - evaporation))
        for distance, e in enumerate(reversed(trail[-tail:]) if reward > 0 else [edge]):
            level[e] = min(high, max(low, level[e] + reward * 0.6**distance))
    run = steps["run"].iloc[0]
    return pd.DataFrame([(run, e, round(x, 9)) for e, x in sorted(level.items())], columns=["run", "edge", "pheromone"])


def replay_pheromones(steps: DataFrame, evaporation: float = 0.15, low: float = 0.05, high: float = 5.0, tail: int = 4) -> DataFrame:
    """pheromones() of every run as a stream over rows sorted by run and step.

    A task holds the levels and the last `tail` edges of one run, so a run may have any number of steps.
    An edge evaporates when it is touched, for all the steps since it was; the
    work is that of the steps, not of steps times edges.
    """

    def replay(batches):
        run, level, trail, n = None, None, [], 0

        def now(e):
            value, since = level[e]
            return max(low, value * (1 - evaporation) ** (n - since))

        def give():
            edges = sorted(level, key=lambda e: (e is None, e))
            return pa.RecordBatch.from_arrays([pa.array([run] * len(edges), pa.int64()), pa.array(edges, pa.int64()), pa.array([round(now(e), 9) for e in edges], pa.float64())], ["run", "edge", "pheromone"])

        for batch in batches:
            for one, edge, reward in zip(*(batch.column(c).to_pylist() for c in ("run", "edge", "reward"))):
                if level is None or one != run:
                    if level is not None:
                        yield give()
                    run, level, trail, n = one, {}, [], 0
                trail = [*trail, edge][-tail:]
                level.setdefault(edge, (1.0, n))
                n += 1
                for distance, e in enumerate(reversed(trail) if reward > 0 else [edge]):
                    level[e] = min(high, max(low, now(e) + reward * 0.6**distance)), n
        if level is not None:
            yield give()

    rows = steps.select(F.col("run").cast("long").alias("run"), "step", F.col("edge").cast("long").alias("edge"), F.col("reward").cast("double").alias("reward"))
    return rows.repartition("run").sortWithinPartitions("run", "step").mapInArrow(replay, "run long, edge long, pheromone double")


def _drawn(*parts) -> Column:
    """SHA-256 of the parts, in hex: the source of every random draw."""
    return F.sha2(F.concat_ws("|", *(x if isinstance(x, Column) else F.lit(str(x)) for x in parts)), 256)


def _gumbel(hex_: Column) -> Column:
    u = (F.conv(F.substring(hex_, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def random_walks(links: DataFrame, starts: DataFrame, seed: str, stop: float, most: int) -> DataFrame:
    """(run, steps, path): seeded walks from starts(run, start), all of them one link at a time.

    A walk ends with probability `stop` after each step, where a page has no
    link, and after `most` pages.  The next page is the one with the least hash
    of (seed, run, step, page): a uniform pick without an order of the links.
    """
    links = settle(links.select("source", "target").distinct(), "links")
    live = settle(starts.select("run", F.col("start").alias("at"), F.col("start").cast("string").alias("path")), "walk")
    out = live.select("run", F.lit(1).cast("long").alias("steps"), "path")
    for k in range(most - 1):
        going = live.where(F.substring(_drawn(seed, F.col("run").cast("string"), k, "stop"), 1, 8) >= f"{int(stop * (1 << 32)):08x}")
        step = going.join(links, going.at == links.source).groupBy("run", "path").agg(F.min_by("target", _drawn(seed, F.col("run").cast("string"), k, F.col("target").cast("string"))).alias("at"))
        live = settle(step.select("run", "at", F.concat_ws(">", "path", F.col("at").cast("string")).alias("path")), "walk")
        out = out.unionByName(live.select("run", F.lit(k + 2).cast("long").alias("steps"), "path"))
    return out.groupBy("run").agg(F.max("steps").alias("steps"), F.max_by("path", "steps").alias("path"))


def ant_search(edges: DataFrame, starts: DataFrame, seed: str, ants: int = 4, steps: int = 10, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0) -> DataFrame:
    """(run, ant, steps, path, reward): ants that walk edges(source, target, score, heuristic) from starts(run, start).

    The ants of a run follow each other, since each leaves pheromone for the
    next; all runs advance together, one join of their places with the edges for
    each step.  The next target is drawn with weight exp(beta score + alpha
    ln(level) + gamma heuristic), by the greatest of the logarithms with Gumbel
    noise.  An ant stops where no unvisited target is left and after `steps`.
    All levels evaporate by 0.15 after each ant, then its last four edges are
    rewarded by its mean score, less with distance.
    """
    edges = settle(edges.groupBy("source", "target").agg(F.max("score").alias("score"), F.max("heuristic").alias("heuristic")), "edges")
    levels, out = None, None
    for ant in range(ants):
        live = settle(starts.select("run", F.array("start").alias("seen"), F.array().cast("array<double>").alias("gains")), "ants")
        ended = None
        for k in range(steps):
            here = live.withColumn("source", F.element_at("seen", -1))
            open_ = here.join(edges, "source").where(~F.array_contains("seen", F.col("target")))
            if levels is not None:
                open_ = open_.join(levels, ["run", "source", "target"], "left")
            level = F.coalesce("level", F.lit(1.0)) if levels is not None else F.lit(1.0)
            noise = _gumbel(_drawn(seed, F.col("run").cast("string"), ant, k, F.col("target").cast("string")))
            value = beta * F.col("score") + alpha * F.log(level) + gamma * F.col("heuristic") + noise
            pick = open_.groupBy("run").agg(F.max_by(F.struct("target", "score"), F.struct(value, "target")).alias("x"))
            moved = live.join(pick, "run", "left")
            grown = moved.select("run", F.when(F.col("x").isNull(), F.col("seen")).otherwise(F.concat("seen", F.array("x.target"))).alias("seen"), F.when(F.col("x").isNull(), F.col("gains")).otherwise(F.concat("gains", F.array("x.score"))).alias("gains"), F.col("x").isNull().alias("over"))
            grown = settle(grown, "ants")
            stuck = grown.where("over").drop("over")
            ended = stuck if ended is None else ended.unionByName(stuck)
            live = grown.where("not over").drop("over")
        done = live if ended is None else live.unionByName(ended)
        reward = F.when(F.size("gains") > 0, F.aggregate("gains", F.lit(0.0), lambda s, x: s + x) / F.size("gains")).otherwise(0.0)
        done = settle(done.withColumn("reward", reward), "ants")
        row = done.select("run", F.lit(ant).cast("long").alias("ant"), F.size("gains").cast("long").alias("steps"), F.array_join(F.slice(F.col("seen").cast("array<string>"), 2, steps), ">").alias("path"), F.round("reward", 6).alias("reward"))
        out = row if out is None else out.unionByName(row)
        laid = done.where(F.size("gains") > 0).select("run", "reward", F.posexplode(F.sequence(F.lit(1), F.least(F.lit(4), F.size("gains")))).alias("distance", "back"), "seen")
        laid = laid.select("run", F.element_at("seen", -F.col("back") - 1).alias("source"), F.element_at("seen", -F.col("back")).alias("target"), (F.col("reward") * F.pow(F.lit(0.6), F.col("distance"))).alias("more"))
        old = laid.limit(0).select("run", "source", "target", F.lit(1.0).alias("level")) if levels is None else levels
        faded = old.withColumn("level", F.greatest(F.lit(0.05), F.col("level") * 0.85))
        both = faded.join(laid, ["run", "source", "target"], "full")
        levels = settle(both.select("run", "source", "target", F.least(F.lit(5.0), F.greatest(F.lit(0.05), F.coalesce("level", F.lit(1.0)) + F.coalesce("more", F.lit(0.0)))).alias("level")), "levels")
    return out
