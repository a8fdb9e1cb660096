import numpy as np
import pytest

from strataline.llm import tokencounts as C

RANKS = open(C.RANK_FILE, "rb").read()
TEXTS = ["one two\n\n  three é four\nünï 日本語 end", "", None, "\n", "no newline", "tail\n", "word " * 100_000]


def brute(text, ends, rule):
    """Byte by byte: the section of each byte, then the rule for each token."""
    raw = (text or "").encode()
    bounds = [0, *ends]
    section = np.zeros(max(1, len(raw)), int)
    for k in range(len(bounds) - 1):
        section[bounds[k] : bounds[k + 1]] = k
    out = np.zeros(len(ends))
    at = 0
    for end in C.token_ends(text, RANKS).tolist() if text else []:
        own = section[at:end]
        if rule == "start":
            out[own[0]] += 1
        elif rule == "end":
            out[own[-1]] += 1
        elif rule == "most":
            out[np.bincount(own).argmax()] += 1
        else:
            out += np.bincount(own, minlength=len(out)) / len(own)
        at = end
    assert at == len(raw)
    return out


def line_ends(text):
    raw, out = (text or "").encode(), []
    for line in raw.splitlines(keepends=True) if b"\r" not in raw else []:
        out.append((out[-1] if out else 0) + len(line))
    return out or [0]


@pytest.mark.parametrize("rule", C.RULES)
def test_lines_match_brute_force(spark, rule):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a\nb", "x")], "doc_id long, text string, key string")
    got = {r.key: r for r in C.section_tokens(docs, rule=rule).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        assert np.allclose(got[i].section_tokens, brute(t, line_ends(t), rule))
        assert got[i].n_tokens == round(sum(got[i].section_tokens))


def test_fields_and_empty(spark):
    docs = spark.createDataFrame([("k", "Title é", None, "body text here"), ("l", "", "", "")], "id string, a string, b string, c string")
    got = {r.key: r for r in C.field_tokens(docs, "id", ["a", "b", "c"]).collect()}
    whole = "Title é\n\nbody text here"
    ends = [len("Title é\n".encode()), len("Title é\n\n".encode()), len(whole.encode())]
    assert np.allclose(got["k"].section_tokens, brute(whole, ends, "start"))
    assert got["l"].n_tokens > 0 or got["l"].section_tokens == [0, 0, 0]
    assert C.section_tokens(docs.limit(0), "id", "a").count() == 0
    with pytest.raises(ValueError):
        C.allocate(np.array([1]), np.array([1]), "none")
