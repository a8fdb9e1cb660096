import math
from collections import Counter

import numpy as np
import pytest

from strataline.llm import pieces as P
from strataline.llm import textkit as K

MODEL = P.PieceModel(open(P.MODEL_FILE, "rb").read())


def every(text):
    """All segmentations of a text by plain recursion over the pieces, with unnormalised log-probabilities."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL_FILE)
    usable = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    whole, out = "▁" + text.replace(" ", "▁"), {}

    def go(at, ids, logp):
        if at == len(whole):
            out[tuple(ids)] = logp
            return
        for k in range(1, MODEL.longest + 1):
            i = usable.get(whole[at : at + k])
            if i is not None and at + k <= len(whole):
                go(at + k, [*ids, i], logp + MODEL.logp[i])
        if whole[at] not in usable:
            raw = whole[at].encode()
            go(at + 1, [*ids, *MODEL.byte_ids[list(raw)].tolist()], logp + len(raw) * MODEL.logp[MODEL.byte_ids[0]])

    go(0, [], 0.0)
    total = math.log(sum(math.exp(v) for v in out.values()))
    return {k: v - total for k, v in out.items()}


@pytest.mark.parametrize("text", ["the cat é", "a  b\n日本x", "Ａb"])
def test_first_samples_follow_the_distribution(text):
    want, n = every(text), 6000
    lattice = P.Lattice(MODEL, [text] * n)
    searches = P.sample_texts(lattice, 0, n, K.mix(np.arange(n, dtype=np.uint64)), 3)
    paths = [[tuple(x.tolist()) for x in P.path_ids(lattice, [p for _, p in s.best])] for s in searches]
    assert all(len(set(x)) == len(x) == min(3, len(want)) for x in paths)
    assert all(x.best[k][0] >= x.best[k + 1][0] for x in searches for k in range(len(x.best) - 1))
    for s, ids in zip(searches[:200], paths):
        assert all(abs(p.before[-1] - want[i]) < 1e-4 for (_, p), i in zip(s.best, ids))
    first, second = Counter(x[0] for x in paths), Counter(x[1] for x in paths if len(x) > 1)
    p = {k: math.exp(v) for k, v in want.items()}
    for ids in sorted(p, key=p.get)[-4:]:
        if len(want) == 1:
            break
        then = sum(p[a] * p[ids] / (1 - p[a]) for a in p if a != ids)
        assert abs(first[ids] / n - p[ids]) < 0.03 and abs(second[ids] / n - then) < 0.03
    # weights by inclusion scores make the samples stand for the whole distribution
    weights = [sum(math.exp(b.before[-1]) / math.exp(P.log_inclusion(b.before[-1], -s.heap[0][0] if s.heap else None)) for _, b in s.best) for s in searches]
    assert abs(np.mean(weights) - 1) < 0.03


@pytest.mark.parametrize("text", ["the cat", "in", "= ab", "日x", "national"])
def test_all_segmentations_come_once(text):
    """More samples than there are give every segmentation, however improbable, with its own probability."""
    want = every(text)
    lattice = P.Lattice(MODEL, [text])
    (search,) = P.sample_texts(lattice, 0, 1, K.mix(np.arange(3, 4, dtype=np.uint64)), len(want) + 3)
    got = [tuple(x.tolist()) for x in P.path_ids(lattice, [p for _, p in search.best])]
    assert len(got) == len(set(got)) and set(got) == set(want)
    assert all(abs(p.before[-1] - want[i]) < 1e-4 for (_, p), i in zip(search.best, got)) and not search.heap


def test_improbable_branches_are_found():
    """With one piece made nearly certain, the other ways have less than 1e-15, and all still come."""
    model = P.PieceModel(open(P.MODEL_FILE, "rb").read())
    text = "the"
    sure = next(i for i in range(len(model.bytes_of)) if model.bytes_of[i] == b" the")
    model.logp = model.logp - 40.0
    model.logp[sure] = -0.001
    model.step_logp[: len(model.logp)] = model.logp.astype(np.float32)
    ways = len(every(text))
    for samples in (2, ways):
        lattice = P.Lattice(model, [text] * 30)
        searches = P.sample_texts(lattice, 0, 30, K.mix(np.arange(30, dtype=np.uint64)), samples)
        for s in searches:
            paths = [tuple(x.tolist()) for x in P.path_ids(lattice, [p for _, p in s.best])]
            assert len(set(paths)) == samples and paths[0] == (sure,) and s.best[1][1].before[-1] < -35


def test_long_units_in_lanes(monkeypatch):
    import random

    rng = random.Random(4)
    text = "".join(rng.choice(["the", "of", "qu", "tion", "er", "x", "日", "==="]) for _ in range(3000))
    seeds = K.mix(np.arange(2, dtype=np.uint64))
    found = []
    for lane in (1 << 40, 257, 64):
        monkeypatch.setattr(P, "_LONG", lane)
        lattice = P.Lattice(MODEL, [text, text[:999]])
        paths = [p for s in P.sample_texts(lattice, 0, 2, seeds, 3) for _, p in s.best]
        found.append(([x.tolist() for x in P.path_ids(lattice, paths)], [p.before[-1] for p in paths]))
    assert all(x[0] == found[0][0] and np.allclose(x[1], found[0][1], atol=1e-6) for x in found)


def test_lattice_holds_only_pieces_that_are_there():
    """A place has about two pieces of up to 16 lengths: its arrays follow the pieces, in memory and so in work."""
    import random

    rng = random.Random(8)
    text = " ".join("".join(rng.choice(["the", "of", "qu", "tion", "er", "x", "an"]) for _ in range(4)) + str(i) for i in range(5000))
    lattice = P.Lattice(MODEL, [text])
    assert sum(v.nbytes for v in vars(lattice).values() if isinstance(v, np.ndarray)) < 60 * len(text)


@pytest.mark.parametrize("lane", [4, 2048])
def test_places_have_all_their_pieces(monkeypatch, lane):
    """The pieces that end at each place, and their shares, are those of a plain scan, in both numberings of the places."""
    monkeypatch.setattr(P, "_LONG", lane)
    text = "the nation == 日本x"
    lattice = P.Lattice(MODEL, [text])
    usable = {MODEL.bytes_of[i]: i for i in np.flatnonzero(MODEL.logp > -np.inf) if i not in set(MODEL.byte_ids.tolist())}
    for unit, (first, size) in enumerate(zip(lattice.first.tolist(), lattice.size.tolist())):
        chars = (" " + text)[first : first + size]
        for place in range(1, size + 1):
            state = lattice.state(unit, place)
            part = slice(int(lattice.entry[state]), int(lattice.entry[state + 1]))
            want = {k: usable[x] for k in range(1, place + 1) if (x := chars[place - k : place].encode()) in usable}
            got = dict(zip(lattice.length[part].tolist(), lattice.piece[part].tolist()))
            assert got == (want or {1: P._BYTES})
            first_entry, logs = lattice.state_logs(unit, place)
            assert first_entry == part.start and np.allclose(np.cumsum(np.exp(logs)), lattice.choice[part], atol=1e-6)


def test_carried_columns_and_repeats(spark):
    docs = spark.createDataFrame([(1, "some words", "x", 5, {"a": 1}), (1, "some words", "y", 6, None), (None, None, None, None, None)], "doc_id long, text string, lang string, sample int, `odd name` map<string,int>")
    got = P.sample_segmentations(docs, carry=tuple(docs.columns)).collect()
    assert got[0].asDict().keys() == {"key", *P._OUT, "ids", "doc_id", "text", "lang", "odd name"}
    assert sorted((r.lang, r["odd name"], r.text, r.sample) for r in got if r.lang) == [("x", {"a": 1}, "some words", 0), ("x", {"a": 1}, "some words", 1), ("y", None, "some words", 0), ("y", None, "some words", 1)]
    assert len({tuple(r.ids) for r in got if r.lang}) == 2


def test_unspaced_million(spark):
    text = "abcdefghij" * 100_000
    got = P.sample_segmentations(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(got) == 2 and all(r.round_trip for r in got)


def test_round_trip_and_edges(spark):
    texts = ["plain words here", "", None, " lead  and trail ", "▁ literal ▁▁ marks", "tab\tnew\nline\r\n", "日本語 😀 é\x00", "\U0010ffff▁x", "=" * 5000, "word " * 60_000, "a"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, "no key", "x")], "doc_id long, text string, key string")
    got = P.sample_segmentations(docs, samples=3).collect()
    assert all(r.round_trip for r in got)
    by = {}
    for r in got:
        by.setdefault(r.key, []).append(tuple(r.ids))
        assert r.n_pieces == len(r.ids) and r.log_prob - 1e-6 <= r.log_inclusion <= 0 or r.n_pieces < 9 and r.log_prob <= 0
    assert by[1] == by[2] == [()]
    assert len(set(by[0])) == 3 and sorted(by[0][:3]) == sorted(by[0][3:])
    assert all(len(set(v)) == len(v) for k, v in by.items() if k not in (0,))
    decoded = P.decode_pieces(P.sample_segmentations(docs)).collect()
    assert all(r.decoded == texts[r.key] for r in decoded if r.key not in (None, 1, 2))
    assert P.sample_segmentations(docs.limit(0)).count() == 0
