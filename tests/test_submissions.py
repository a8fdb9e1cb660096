"""Submissions validated by joins, against the sequential form, also with the claims permuted."""

import random

import pytest

from strataline.operators import submissions as S

REQUIRED = "case long, pos int, claim_id string, subject string, relation string, object string, event_time string"
CLAIMS = REQUIRED + ", cited array<string>"


def norm(x):
    return " ".join((x or "").split()).lower()


def made(seed):
    rng = random.Random(seed)
    required, claims, evidence, witnesses, decisions, cases, tails, tail_claims = ([] for _ in range(8))
    for case in range(25):
        n = rng.randrange(5)
        for k in range(n):
            claim = (rng.choice(["A", "B "]), rng.choice(["r", "s"]), rng.choice(["x", "Y"]), rng.choice([None, "2024"]))
            required.append((case, k, f"c{k}", *claim))
            if rng.random() < 0.9:
                claims.append((case, 0, rng.choice([f"c{k}", None, "", None]), claim[0].lower(), claim[1], claim[2] if rng.random() < 0.9 else "z", claim[3] if rng.random() < 0.8 else "2023", rng.sample(["e1", "e2", "e3"], rng.randrange(3))))
            if rng.random() < 0.6:
                witnesses.append((case, f"c{k}", rng.choice(["e1", "e2", "e3"])))
            elif rng.random() < 0.7:
                decisions.append((case, f"c{k}", rng.random() < 0.7))
        last = required[-1][5] if n else "q"
        tails.append((case, 99, "tail", last if rng.random() < 0.8 else "w", "t", "Goal", None))
        tail_claims.append((case, 99, "tail", tails[-1][3], rng.choice("tttu"), rng.choice(["goal", "The Goal", "no"]), None, ["e1"]))
        witnesses.append((case, "tail", "e1"))
        cases.append((case, rng.choice(["goal", "the  goal", "no"]), ["Goal", "the goal"], rng.random() < 0.9))
        evidence += [(case, e, rng.choice(["the GOAL is here", "nothing"])) for e in ("e1", "e2") if rng.random() < 0.9]
    own = [c for c in claims]
    rng.shuffle(own)
    claims = [(c[0], i, *c[2:]) for i, c in enumerate(own)]
    return required, claims, evidence, witnesses, decisions, cases, tails, tail_claims


def plain(required, claims, evidence, witnesses, decisions, cases, tails, tail_claims):
    out = {}
    for case, answer, aliases, actions in cases:
        pages = {e: t for c, e, t in evidence if c == case}
        own = sorted((c for c in claims if c[0] == case), key=lambda c: c[1])
        by_id, unused = {c[2]: c for c in own if c[2]}, [c for c in own if not c[2]]
        shape = lambda r, c, objects: norm(r[3]) == norm(c[3]) and norm(r[4]) == norm(c[4]) and norm(c[5]) in objects

        def judge(r, c, objects):
            cited = list(dict.fromkeys(c[7]))
            owned, fits = bool(cited) and all(e in pages for e in cited), shape(r, c, objects)  # noqa: B023
            witness = any((case, r[2], e) in witnesses for e in cited)  # noqa: B023
            judged = any(d[:2] == (case, r[2]) and d[2] for d in decisions)  # noqa: B023
            in_time = r[6] is None or r[6] == c[6]
            return owned and fits and (witness or judged) and in_time, in_time, fits

        results = []
        for r in sorted((r for r in required if r[0] == case), key=lambda r: r[1]):
            c = by_id.get(r[2])
            if c is None:
                c = next((c for c in unused if shape(r, c, {norm(r[5])})), None)
                if c is not None:
                    unused.remove(c)
            results.append((False, False) if c is None else judge(r, c, {norm(r[5])})[:2])
        tail, said = next(t for t in tails if t[0] == case), next(t for t in tail_claims if t[0] == case)
        names = {norm(a) for a in aliases}
        tail_passed, _, _ = judge(tail, said, {norm(tail[5]), *names})
        correct = norm(answer) in names
        literal = any(norm(answer) in norm(pages[e]) for e in said[7] if e in pages)
        bridge = next((norm(r[5]) for r in sorted((r for r in required if r[0] == case), key=lambda r: -r[1])), "")
        flags = [actions, correct, literal, bool(results) and all(p for p, _ in results), tail_passed, bool(results) and all(t for _, t in results), bridge == norm(tail[3]) == norm(said[3]) and norm(said[5]) in {norm(tail[5]), *names} and correct]
        out[case] = (len(results), sum(p for p, _ in results), *flags, all(flags))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_sequential_form(spark, seed):
    parts = made(seed)
    required, claims, evidence, witnesses, decisions, cases, tails, tail_claims = parts
    df = spark.createDataFrame
    matched = S.match_claims(df(required, REQUIRED), df(claims, CLAIMS))
    assert matched.count() == len(required)
    tail = S.match_claims(df(tails, REQUIRED), df(tail_claims, CLAIMS))
    both = matched.selectExpr("*", "false AS tail").unionByName(tail.selectExpr("*", "true AS tail"))
    c = df(cases, "case long, answer string, aliases array<string>, actions_valid boolean")
    results = S.claim_results(both, c, df(evidence, "case long, evidence_id string, content string"), df(witnesses, "case long, claim_id string, evidence_id string"), df(decisions, "case long, claim_id string, supported boolean"))
    got = {r[0]: tuple(r)[1:] for r in S.validate_submissions(results, c).collect()}
    want = plain(*parts)
    assert got == want and len({w[-1] for w in want.values()}) >= 1 and any(w[1] for w in want.values())


def test_unnamed_claims_are_used_once_and_in_order(spark):
    required = spark.createDataFrame([(1, k, f"c{k}", "a", "r", "x", None) for k in range(3)], REQUIRED)
    claims = spark.createDataFrame([(1, 0, "c1", "a", "r", "x", "named", []), (1, 1, None, "A", "r", "X", "first", []), (1, 2, "", "a", "r", "y", "other", []), (1, 3, "c1", "a", "r", "x", "named again", [])], CLAIMS)
    got = {r.claim_id: r.claim and r.claim.event_time for r in S.match_claims(required, claims).collect()}
    assert got == {"c0": "first", "c1": "named again", "c2": None}
