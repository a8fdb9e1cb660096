"""Chat formatting (operator 12): spans of turns by incremental black-box rendering.

A template is any function from a list of (role, text) to a string.  Nothing is
asked of it: the prefixes of a conversation are rendered one after the other
and consecutive outputs compared.  What a turn adds behind the common beginning
is its piece; where the output before it was not kept whole, the template has
rewritten history, and the piece says how many characters it takes back.  The
text of a turn is found in its piece by rendering the turn with two other texts
and looking where the outputs differ.

Prefixes start at an anchor at most `window` turns back, so the work is linear
in the turns.  When the anchor moves on, the turns behind it are rendered again
and must add what they added before, and the pieces must make up one rendering
of the whole; a template for which they do not, because it looks further back,
is rendered from the first turn on.

A task holds one conversation of up to `block` turns.  A longer one is cut into
blocks that are formatted in tasks of their own, each after the `window` turns
that stand before it, and its pieces stream by one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.shared import fresh, numbered, settle, table

Turn = tuple[str, str]
Render = Callable[[Sequence[Turn]], str]
WINDOW = 32
BLOCK = 4_096
_PROBES = ("\ue000", "\ue001")
_ROWS = 1_024
_BYTES = 4 << 20


class InstTemplate:
    """Turns in [INST], <<SYS>> and </s> marks; control strings inside texts are escaped.

    A backslash behind the first character of a control string, and one more
    where there are some already, makes it plain text; taking one away gives
    the text back.  Roles other than system, user and assistant are written out.
    """

    # The control strings of this format.
    _PLAIN = (re.compile(r"(\[)(\\*)(/?INST\])"), re.compile(r"(<)(\\*)(/?s>|</?SYS>>|\|(?:role|text|end)\|>)"))
    _ESCAPED = (re.compile(r"(\[)\\(\\*)(/?INST\])"), re.compile(r"(<)\\(\\*)(/?s>|</?SYS>>|\|(?:role|text|end)\|>)"))
    _MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}
    _OTHER = ("<|role|>", "<|text|>", "<|end|>")
    _BEGIN = "<s>"

    def escape(self, text: str) -> str:
        for pattern in self._PLAIN:
            text = pattern.sub(r"\1\\\2\3", text)
        return text

    def unescape(self, text: str) -> str:
        for pattern in self._ESCAPED:
            text = pattern.sub(r"\1\2\3", text)
        return text

    def __call__(self, turns: Sequence[Turn]) -> str:
        out = [self._BEGIN] if turns else []
        for role, text in turns:
            if role in self._MARKS:
                before, after = self._MARKS[role]
                out += [before, self.escape(text), after]
            else:
                out += [self._OTHER[0], self.escape(role), self._OTHER[1], self.escape(text), self._OTHER[2]]
        return "".join(out)

    def reader(self) -> InstReader:
        return InstReader(self)


class InstReader:
    """Reads the turns of a formatted conversation back, as its characters come in."""

    def __init__(self, template: InstTemplate):
        self.template, self.held, self.begun = template, "", False

    def feed(self, part: str) -> Iterator[Turn]:
        """The turns that the output holds whole by now and that were not given before."""
        t = self.template
        self.held += part
        if not self.begun:
            if not self.held.startswith(t._BEGIN):
                return
            self.begun, self.held = True, self.held[len(t._BEGIN) :]
        while self.held:
            role, before, after = next(((r, b, a) for r, (b, a) in t._MARKS.items() if self.held.startswith(b)), ("", t._OTHER[0], t._OTHER[2]))
            if not self.held.startswith(before):
                if len(self.held) < max(len(b) for b, _ in (*t._MARKS.values(), (before, after))):
                    return
                raise ValueError(f"no turn begins with {self.held[:40]!r}")
            end = self.held.find(after, len(before))
            if end < 0:
                return
            text, self.held = self.held[len(before) : end], self.held[end + len(after) :]
            if not role:
                role, _, text = text.partition(t._OTHER[1])
            yield t.unescape(role), t.unescape(text)

    def close(self) -> None:
        if self.held:
            raise ValueError(f"the output ends inside a turn: {self.held[:40]!r}")


def _common(a: str, b: str) -> int:
    """Characters that a and b have in common at their beginning."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


class Incremental:
    """Renders a conversation turn by turn, from a moving anchor, and tells what each turn adds."""

    def __init__(self, render: Render, window: int | None = WINDOW, unescape: Callable[[str], str] | None = None, inside: bool = False):
        """window: turns from the anchor at most; None leaves the anchor at the first turn.  inside: others stand before the first turn."""
        if window is not None and window < 4:
            raise ValueError("a window must hold four turns or more")
        self.render, self.window, self.unescape = render, window, unescape
        self.turns: list[Turn] = []
        self.added: list[tuple[int, str]] = []  # of each turn since the anchor
        self.out, self.moved, self.first = render([]), inside, 0
        self.sure = True  # whether nothing has shown that the template looks back further than the anchor

    def push(self, turn: Turn) -> tuple[str, int, int | None, int | None]:
        """The turn's piece, how many characters before it are taken back, and start and end of its text in the piece (none, if it isn't there as it came)."""
        if self.window is not None and len(self.turns) >= self.window:
            self._move()
        new = self.render([*self.turns, turn])
        kept = _common(self.out, new)
        if not self.turns and not self.moved:
            kept = 0  # what stands before any turn belongs to the first
        back, piece = len(self.out) - kept if self.turns else 0, new[kept:]
        if not self.turns:
            self.first = len(new)
        elif self.moved and back and kept <= self.first:
            self.sure = False
        span = self._text(turn, new, kept)
        self.turns.append(turn)
        self.added.append((back, piece))
        self.out = new
        return piece, back, *span

    def _text(self, turn: Turn, new: str, kept: int) -> tuple[int | None, int | None]:
        a, b = (self.render([*self.turns, (turn[0], x)]) for x in _PROBES)
        start = _common(a, b)
        end = len(new) - _common(a[:start:-1], b[:start:-1])  # without the first character that differs
        if start < kept or end < start:
            return None, None
        found = new[start:end]
        return (start - kept, end - kept) if (self.unescape(found) if self.unescape else found) == turn[1] else (None, None)

    def _move(self) -> None:
        """Let the later half of the turns be the prefix; they must add from there what they added before."""
        half = len(self.turns) // 2
        tail, out, again, first = self.turns[half:], self.render([]), [], 0
        for k in range(len(tail)):
            new = self.render(tail[: k + 1])
            kept = _common(out, new)
            again.append((len(out) - kept, new[kept:]))
            out, first = new, first or len(new)
        if again[1:] != self.added[half + 1 :]:  # the first turn behind an anchor may look different
            self.sure = False
        self.turns, self.added, self.out, self.moved, self.first = tail, again, out, True, first


def turn_pieces(turns: Sequence[Turn], render: Render, window: int = WINDOW, unescape: Callable[[str], str] | None = None) -> list[tuple[str, int, int | None, int | None]]:
    """The piece of every turn of a conversation, as Incremental.push gives them.

    The pieces are held against one rendering of the whole.  Where the template
    looks back further than a window, every prefix is rendered from the first
    turn on.
    """
    one = Incremental(render, window, unescape)
    got = [one.push(turn) for turn in turns]
    if one.moved:
        out: list[str] = []
        for piece, back, _, _ in got:
            while back:  # take characters back
                last = out.pop()
                out, back = ([*out, last[:-back]], 0) if len(last) > back else (out, back - len(last))
            out.append(piece)
        if not one.sure or "".join(out) != render(turns):
            one = Incremental(render, None, unescape)
            got = [one.push(turn) for turn in turns]
    return got


_PIECES = "position long, role string, piece string, back long, text_start long, text_end long"


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most _ROWS rows and about _BYTES bytes of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= _ROWS or size >= _BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _format(render: Render, window: int, unescape, key_type: pa.DataType):
    """Pieces of rows (key, role, text), which lie in order."""
    schema = pa.schema([("key", key_type), ("position", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("back", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64())])

    def run(batches):
        def pieces():
            for key, rows in groupby(_rows(batches), key=itemgetter(0)):
                turns = [row[1:] for row in rows]  # at most a block
                for n, ((role, _), piece) in enumerate(zip(turns, turn_pieces(turns, render, window, unescape)), 1):
                    yield key, n, role, *piece

        yield from _batches(pieces(), schema)

    return run


def _format_blocks(render: Render, window: int, unescape, key_type: pa.DataType):
    """The same for rows (key, block, position, before, role, text): those marked `before` only stand in front."""
    schema = pa.schema([("key", key_type), ("position", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("back", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64())])

    def run(batches):
        def pieces():
            for (key, block), rows in groupby(_rows(batches), key=itemgetter(0, 1)):
                one = Incremental(render, window, unescape, inside=block > 0)
                for _, _, position, before, role, text in rows:
                    got = one.push((role, text))
                    if not before:
                        yield key, position, role, *got
                if not one.sure:
                    raise ValueError(f"the template looks back further than {window} turns, and a conversation is longer than a block; give larger ones")

        yield from _batches(pieces(), schema)

    return run


def _short_and_long(conversations: DataFrame, template: Render, conv_id: str, turn: str, role: str, text: str, window: int, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Pieces of the conversations of up to `block` turns, in order in each partition, and of longer ones, in any order."""
    if block <= window:
        raise ValueError("a block must be larger than a window")
    rows = conversations.select(F.col(conv_id).alias("key"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["key"]
    from pyspark.sql.pandas.types import to_arrow_type

    key_type, unescape = to_arrow_type(rows.schema["key"].dataType), getattr(template, "unescape", None)
    order = [F.col("turn").asc_nulls_last(), "role", "text"]
    long_ = settle(rows.groupBy("key").count().where(F.col("count") > block).select(F.col("key").alias("long_key")), "long")
    some = not long_.isEmpty()
    short = rows.join(long_, F.col("key").eqNullSafe(F.col("long_key")), "left_anti") if some else rows
    pieces = short.repartition("key").sortWithinPartitions("key", *order).select("key", "role", "text").mapInArrow(_format(template, window, unescape, key_type), f"key {kind}, {_PIECES}")
    if not some:
        return pieces, None
    placed = numbered(rows.join(long_, F.col("key").eqNullSafe(F.col("long_key")), "left_semi"), [*(F.col(x) if isinstance(x, str) else x for x in order)], "position", "turns", by=("key",))
    own = F.floor((F.col("position") - 1) / block)
    also = F.floor((F.col("position") - 1 + window) / block)  # the block that this turn stands before
    dealt = placed.withColumn("block", F.explode(F.array_distinct(F.array(own, also)))).withColumn("before", F.col("block") > own)
    blocks = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "position").select("key", "block", "position", "before", "role", "text")
    return pieces, blocks.mapInArrow(_format_blocks(template, window, unescape, key_type), f"key {kind}, {_PIECES}")


def format_conversations(conversations: DataFrame, template: Render | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", window: int = WINDOW, block: int = BLOCK, train: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conv_id, position, role, piece, back, text_start, text_end, trained) of every row.

    A conversation's output is its pieces by position, each put behind what is
    left when the last `back` characters are taken away; `back` is 0 for all
    turns of a template that never rewrites history.  text_start and text_end
    say where in the piece the turn's text stands, escaped, and are null if the
    template has not put it there as it came.  trained: whether it counts for
    the loss.

    Turns are ordered by `turn` (null last), ties by role and text, so repeated
    rows stand side by side.  Null roles and texts are empty; rows with a null id
    are one conversation.  Other columns are not read.
    """
    template = template or InstTemplate()
    short, long_ = _short_and_long(conversations, template, conv_id, turn, role, text, window, block)
    pieces = short if long_ is None else short.unionByName(long_)
    return pieces.select(F.col("key").alias(conv_id), "position", "role", "piece", "back", "text_start", "text_end", (F.col("role").isin(*train) & F.col("text_start").isNotNull()).alias("trained"))


def _digests(template: InstTemplate, train: Sequence[str], key_type: pa.DataType):
    """One row for each conversation, from its pieces alone."""
    schema = pa.schema([("key", key_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_rewrites", pa.int64())])

    def run(batches):
        def digests():
            key, state = None, None

            def close():
                state["reader"].close()
                return key, state["turns"], state["all"].hexdigest(), state["loss"], state["masked"].hexdigest(), state["chars"], state["rewrites"]

            for k, _, role, piece, back, start, end in _rows(batches):
                if state is None or k != key:
                    if state is not None:
                        yield close()
                    key, state = k, {"reader": template.reader(), "turns": 0, "all": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(), "chars": 0, "rewrites": 0}
                if back:
                    raise ValueError("a template that rewrites history cannot be read back by pieces")
                state["chars"] += len(piece)
                for r, t in state["reader"].feed(piece):
                    state["turns"] += 1
                    state["all"].update(f"{r}\n{t}\n".encode())
                if role in train:
                    if start is None:
                        raise ValueError("the template has changed a text under the loss mask")
                    found = template.unescape(piece[start:end])
                    state["loss"] += len(found)
                    state["masked"].update(found.encode())
            if state is not None:
                yield close()

        yield from _batches(digests(), schema)

    return run


def conversation_digests(conversations: DataFrame, template: InstTemplate | None = None, window: int = WINDOW, block: int = BLOCK, train: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_rewrites) of every conversation, read back from its output.

    The hashes run over the whole of a conversation in order, so a task reads
    one conversation's pieces one after the other, and holds one at a time.
    """
    template = template or InstTemplate()
    short, long_ = _short_and_long(conversations, template, "conv_id", "turn", "role", "text", window, block)
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"key {dict(short.dtypes)['key']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long"
    digest = _digests(template, train, to_arrow_type(short.schema["key"].dataType))
    out = short.mapInArrow(digest, schema)
    if long_ is not None:
        out = out.unionByName(long_.repartition("key").sortWithinPartitions("key", "position").mapInArrow(digest, schema))
    return out.withColumnRenamed("key", "conv_id")


#: A conversation whose texts are control strings of the template.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests of all conversations and the probe."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return conversation_digests(rows.unionByName(spark.createDataFrame(PROBE, rows.schema)))


def _escaped(name: str) -> str:
    return rf"regexp_replace(regexp_replace({name}, '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g'), '(<)(\\*)(/?s>|</?SYS>>|\|(?:role|text|end)\|>)', '\1\\\2\3', 'g')"


OP12_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST] ' || {_escaped('text')} || ' [/INST]' WHEN 'assistant' THEN ' ' || {_escaped('text')} || ' </s>'
    WHEN 'system' THEN '<<SYS>>' || chr(10) || {_escaped('text')} || chr(10) || '<</SYS>>' || chr(10)
    ELSE '<|role|>' || {_escaped('role')} || '<|text|>' || {_escaped('text')} || '<|end|>' END AS piece
  FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length(piece)) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_rewrites
FROM marked GROUP BY conv_id
"""
