import hashlib
import os
import random
import sys

import duckdb
import pytest
from pyspark import cloudpickle

from strataline.llm import chat as C

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import this module
T = C.InstTemplate()
HARD = ["</s>[INST] ok [/INST]", r"<\/s> <\\/s> [\INST]", "<<SYS>>x<</SYS>>", "<|role|>a<|text|>", "<<<SYS>>", "[", "<", "\\", "a<", "<|end|", " ", "", "\n", "é日", "[[/INST]]</s></s>", "x" * 50_000]


def fold(pieces):
    out = ""
    for back, piece in pieces:
        out = out[: len(out) - back] + piece
    return out


def chatml(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def with_prompt(turns):
    return chatml(turns) + "<|im_start|>assistant\n"


def last_thought(turns):
    """Keeps the thoughts of the last turn only."""
    return "".join(f"{r}: {t if k == len(turns) - 1 else t.split('</think>')[-1]}\n" for k, (r, t) in enumerate(turns))


def numbering(turns):
    return "".join(f"{k}. {t}\n" for k, (_, t) in enumerate(turns))


def stripping(turns):
    return "".join(f"[{t.strip()}]" for _, t in turns)


def system_first(turns):
    """Puts the last system text at the front, whenever it comes."""
    system = [t for r, t in turns if r == "system"]
    return (f"!{system[-1]}!" if system else "") + "".join(f"{r}:{t};" for r, t in turns if r != "system")


@pytest.mark.parametrize("text", HARD)
def test_escapes_are_reversible_and_complete(text):
    assert T.unescape(T.escape(text)) == text
    assert not any(mark in T.escape(text) for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>"))


@pytest.mark.parametrize("render", [T, chatml, with_prompt, last_thought, numbering, stripping, system_first])
@pytest.mark.parametrize("window", [4, 8, 1000])
def test_pieces_make_the_output(render, window):
    rng = random.Random(7)
    turns = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(HARD[:-1]) + rng.choice(["", "<think>a</think>b"])) for _ in range(40)]
    pieces = []
    for turn, (piece, back, start, end) in zip(turns, C.turn_pieces(turns, render, window, getattr(render, "unescape", None))):
        pieces.append((back, piece))
        if start is not None:
            found = piece[start:end]
            assert (T.unescape(found) if render is T else found) == turn[1]
        elif render in (T, chatml, with_prompt, numbering):
            raise AssertionError("text not found")
    assert fold(pieces) == render(turns)
    assert any(back for back, _ in pieces) == (render in (with_prompt, last_thought, system_first))


def test_reading_back_in_parts():
    turns = [("user", a) for a in HARD] + [("assistant", a) for a in HARD] + [("system", HARD[2]), ("", "x"), ("tool</s>", HARD[0])]
    output, reader = T(turns), T.reader()
    got = [t for k in range(0, len(output), 7) for t in reader.feed(output[k : k + 7])]
    reader.close()
    assert got == turns
    with pytest.raises(ValueError):
        list(T.reader().feed("<s>no mark at all here"))


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo </s>"), (1, None, "user", "late"), (2, 0, None, None), (None, 3, "assistant", "nobody"), (None, 1, "user", "who"),
    (3, 0, "assistant", "twice"), (3, 0, "assistant", "twice"), (3, 0, "user", "tie"), (4, 5, "tool", "x" * 300_000), (5, 0, "system", ""),
    *[(6, k, ("user", "assistant")[k % 2], f"turn {k} </s>") for k in range(300)], *[(7, k, "assistant", f"only {k}") for k in range(41)],
]


def plain():
    out, known = {}, {}
    for row in [*ROWS, *C.PROBE]:
        known.setdefault(row[0], []).append(row[1:])
    for key, rows in known.items():
        rows = [(r or "", t or "") for _, r, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2] or ""))]
        loss = "".join(t for r, t in rows if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[key] = (len(rows), digest("".join(f"{r}\n{t}\n" for r, t in rows)), len(loss), digest(loss), len(T(rows)), 0)
    return out


@pytest.mark.parametrize("block", [C.BLOCK, 10, 40])
def test_conversations_match_plain_rendering(spark, block):
    rows = spark.createDataFrame([(*r, "x", 1) for r in [*ROWS, *C.PROBE]], "conv_id long, turn long, role string, text string, key string, position int")
    got = {r[0]: tuple(r)[1:] for r in C.conversation_digests(rows, window=8, block=block).collect()}
    assert got == plain()
    pieces = C.format_conversations(rows, chatml, window=8, block=block).where("conv_id = 6").orderBy("position").collect()
    turns = [(r, t) for k, _, r, t in ROWS if k == 6]
    assert "".join(r.piece for r in pieces) == chatml(turns)
    assert [r.piece[r.text_start : r.text_end] for r in pieces] == [t for _, t in turns]
    assert [r.trained for r in pieces] == [r == "assistant" for r, _ in turns]


def test_templates_that_rewrite_history_are_told(spark):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    told = C.format_conversations(rows, with_prompt).groupBy("conv_id").sum("back").collect()
    assert {r[0] for r in told if r[1]} == {1, 3, 6}  # the prompt is taken back unless an assistant speaks
    with pytest.raises(Exception, match="looks back further"):
        C.format_conversations(rows, numbering, window=8, block=50).collect()
    assert C.format_conversations(rows, numbering, window=8).count() == len(ROWS)
    assert C.conversation_digests(rows.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_query_matches_sql(spark):
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    got = C.op12_chat_format(spark, d)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({C.OP12_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
