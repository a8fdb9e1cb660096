"""The sequential picks over all rows at once, as the samplers are defined."""

import math

import pandas as pd


def diverse_by_popularity(p: pd.DataFrame, total: int, per_family: int, per_property: int, per_source: int) -> pd.DataFrame:
    """Repeated pick of the greatest ln(max(1, views) + 1) / (1 + 2 f + p + s) under three caps; ties go to more views, then to the greatest id."""
    left = p.sort_values("id").to_dict("records")
    used: dict[tuple, int] = {}
    caps = {"family": per_family, "property": per_property, "source": per_source}
    out = []
    while left and len(out) < total:
        best, at = None, -1
        for i, r in enumerate(left):
            n = {c: used.get((c, r[c]), 0) for c in caps}
            if all(n[c] < caps[c] for c in caps):
                score = math.log1p(max(1, r["views"])) / (1 + 2 * n["family"] + n["property"] + n["source"])
                if best is None or (score, r["views"], r["id"]) > best:
                    best, at = (score, r["views"], r["id"]), i
        if at < 0:
            break
        r = left.pop(at)
        for c in caps:
            used[c, r[c]] = used.get((c, r[c]), 0) + 1
        out.append(r | {"place": len(out)})
    return pd.DataFrame(out, columns=[*p.columns, "place"])


def diverse_by_coverage(p: pd.DataFrame, total: int, caps: dict[str, int]) -> pd.DataFrame:
    """Repeated pick of the row with most new families, then new properties, then score, then greatest id."""
    left = p.sort_values("id").to_dict("records")
    used: dict[tuple, int] = {}
    out = []
    while left and len(out) < total:
        open_ = [r for r in left if all(used.get((c, r[c]), 0) < n for c, n in caps.items())]
        if not open_:
            break
        best = max(open_, key=lambda r: (("family", r["family"]) not in used, ("property", r["property"]) not in used, r["score"], r["id"]))
        left.remove(best)
        for c in {*caps, "family", "property"}:
            used[c, best[c]] = used.get((c, best[c]), 0) + 1
        out.append(best | {"place": len(out)})
    return pd.DataFrame(out, columns=[*p.columns, "place"])


def capped_round_robin(p: pd.DataFrame, total: int, lane: str, caps: dict[str, int]) -> pd.DataFrame:
    """One row of each lane per lap, lanes in order, skipping rows whose capped values are used up."""
    lanes = {k: list(g.sort_values("id").to_dict("records")) for k, g in p.groupby(lane, sort=True)}
    used: dict[tuple, int] = {}
    out, moved = [], True
    while moved and len(out) < total:
        moved = False
        for k in lanes:
            while lanes[k]:
                r = lanes[k].pop(0)
                if all(used.get((c, r[c]), 0) < n for c, n in caps.items()):
                    for c in caps:
                        used[c, r[c]] = used.get((c, r[c]), 0) + 1
                    out.append(r | {"place": len(out)})
                    moved = True
                    break
            if len(out) == total:
                break
    return pd.DataFrame(out, columns=[*p.columns, "place"])
