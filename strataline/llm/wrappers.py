"""HTML extraction (operator 8): wrappers as union-free regular expressions.

The token streams of pages of one host are aligned one after the other.  Tags
nest a stream into levels, and each level is aligned as a sequence: a mismatch
of texts becomes a text slot, following items of one kind become a repeated
group, and items that some pages lack become optional.  The outcome is the
host's wrapper, an expression of tags, slots, `?` and `+` without alternatives.

Every task aligns the pages it reads into one partial wrapper for each host, so
only wrappers are shuffled; partial wrappers are aligned with each other in
rounds of bounded fan-in.  The wrapper then tells which items may belong to the
main text: a text that stays the same over the pages of a host, an item that
only some pages have, and lists of links speak against it, texts that vary speak
for it.  Element names of HTML count by themselves, class words only beside such
evidence.  Every page is read through the wrapper of its host, from the best
candidate that the page has.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.shared import settle, table

FAN_IN = 32
HELD_HOSTS = 2_000
WRAPPER_BYTES = 16 << 20  # wrappers of all hosts up to this size are broadcast
SALTS = 16
DEPTH = 200  # what is nested deeper stands in the level of its outer elements
CELLS = 1_000_000  # longer levels are cut where an alignment of them can be cut

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|textarea|template|svg|iframe)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Element names of HTML and the common words of page furniture.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul video".split()
)
_CLOSES_P = _BLOCK - frozenset("br body html option caption td th tr tbody thead tfoot title".split())
_CONTAINERS = frozenset("div section span table tbody td".split())
_OWN_KIND = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_FURNITURE_TAGS = frozenset("head nav footer aside form button select menu dialog title".split())
_NEVER_MAIN = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo nav navbar navigation breadcrumb breadcrumbs sidebar complementary contentinfo cookie cookies consent popup modal newsletter subscribe signup login comment comments disqus reply replies masthead".split()
)
_HOLDERS = frozenset("area bar block box container content form holder inner item list section slot unit wrap wrapper #".split())
_SELDOM_MAIN = frozenset("banner menu side footer notice alert overlay search share sharing social related recommended widget toolbar pagination pager tags copyright".split())
_COMMENT_WORDS = frozenset("comment comments reply replies".split())
_ONE_COMMENT = frozenset("comment reply".split())
_MAIN_WORDS = frozenset("main article articlebody content post entry story".split())
_TEXT = "#"


class Node:
    """One item of a wrapper: a tag with its level below it, or a text."""

    __slots__ = ("key", "optional", "repeated", "text", "seen", "chars", "below", "role")

    def __init__(self, key: str, text: str | None = None, chars: int = 0):
        self.key, self.text, self.chars = key, text, chars  # text None in a text item: a slot
        self.optional = self.repeated = False
        self.seen, self.below, self.role = 1, [], ()

    def pack(self) -> list:
        return [self.key, int(self.optional), int(self.repeated), self.text, self.seen, self.chars, [x.pack() for x in self.below]]

    @staticmethod
    def unpack(x: list) -> Node:
        node = Node(x[0], x[3], x[5])
        node.optional, node.repeated, node.seen = bool(x[1]), bool(x[2]), x[4]
        node.below = [Node.unpack(y) for y in x[6]]
        return node

    def expression(self) -> str:
        """The item as a readable expression."""
        body = ("#PCDATA" if self.text is None else self.text) if self.key == _TEXT else f"<{self.key}>{''.join(x.expression() for x in self.below)}</{self.key}>"
        mark = {(0, 0): "", (0, 1): "+", (1, 0): "?", (1, 1): "*"}[int(self.optional), int(self.repeated)]
        return f"({body}){mark}" if mark else body


def nested(page: str) -> list:
    """The tokens of a page, nested: [tag key, items below] for tags, and texts as strings.

    Tags that are never closed end with the level that holds them.  What is nested
    deeper than DEPTH stands in the level at that depth, but furniture below it
    keeps what it holds.
    """
    root: list = ["", []]
    stack, at, held = [root], 0, 0  # held: how long the stack is with the furniture below DEPTH that is open
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            if not text.isspace():
                stack[-1][1].append(text)
            elif stack[-1][1]:
                stack[-1][1].append(" ")
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0].split(".", 1)[0] == name:
                    if k >= DEPTH and name in _BLOCK:
                        stack[-1][1].append(" ")
                    del stack[k:]
                    break
            continue
        if name in _CLOSES_P or name in _OWN_KIND:
            ends = (name,) if name in _OWN_KIND else ("p",)
            stop = _OWN_KIND.get(name, ("article", "section", "main", "div", "td", "li", "body", "table", "blockquote", "form"))
            if name in ("dt", "dd"):
                ends = ("dt", "dd")
            if name in ("td", "th"):
                ends = ("td", "th")
            for k in range(len(stack) - 1, 0, -1):
                tag = stack[k][0].split(".", 1)[0]
                if tag in ends:
                    del stack[k:]
                    break
                if tag in stop:
                    break
        item: list = [_key(name, m[4]), []]
        stack[-1][1].append(item)
        if name in _VOID or m[4].rstrip().endswith("/"):
            continue
        if len(stack) < held:
            held = 0
        if len(stack) < DEPTH:
            stack.append(item)
        elif not held and _surely_furniture(item[0]):
            stack.append(item)
            held = len(stack)
        else:
            stack.append([item[0], stack[-1][1]])
    if at < len(page) and not page[at:].isspace():
        stack[-1][1].append(page[at:])
    return root[1]


_DIGITS, _OTHER = re.compile(r"[0-9]+"), re.compile(r"[^a-z#-]")


def _key(name: str, attributes: str) -> str:
    if "=" not in attributes:
        return name
    words = sorted({_OTHER.sub("_", _DIGITS.sub("#", w.lower())) for m in _NAMED.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").split()})
    return ".".join([name, *words])


def _whole(text: str) -> str:
    """A text to be compared: a long one is its beginning and a hash of all of it."""
    return text if len(text) <= 200 else f"{text[:160]}… {hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def wrapper_of(items: list) -> list[Node]:
    """A level of one page as a wrapper: following items of one kind are folded into a repeated group."""
    out: list[Node] = []
    for x in items:
        if isinstance(x, str):
            if x == " ":
                continue
            if out and out[-1].key == _TEXT:
                out[-1].chars += len(x)
                out[-1].text = _whole(f"{out[-1].text} {x.strip()}")
                continue
            node = Node(_TEXT, _whole(x.strip()), len(x))
        else:
            node = Node(x[0])
            node.below = wrapper_of(x[1])
        _put(out, node)
    return out


def _put(out: list[Node], node: Node) -> None:
    """Add an item to a level; after one of its kind it makes a repeated group with it."""
    if out and out[-1].key == node.key and _alike(out[-1], node):
        _join(out[-1], node, same_pages=True)
        out[-1].repeated = True
    else:
        out.append(node)


def _alike(a: Node, b: Node) -> bool:
    """Whether two following items of one key are of one kind: containers only if most of what they hold is the same."""
    if a.key not in _CONTAINERS:
        return True
    one, two = ({x.key for x in n.below} - {_TEXT} for n in (a, b))
    return 2 * len(one & two) > len(one | two) or not one | two


def _join(a: Node, b: Node, same_pages: bool = False) -> None:
    """Let item a match what b matches; `seen` counts pages."""
    a.optional |= b.optional
    a.repeated |= b.repeated
    a.seen = max(a.seen, b.seen) if same_pages else a.seen + b.seen
    a.chars += b.chars
    if a.key == _TEXT:
        a.text = a.text if a.text == b.text else None
    else:
        a.below = align(a.below, b.below, same_pages)


def align(a: list[Node], b: list[Node], same_pages: bool = False) -> list[Node]:
    """One level that matches both: the longest common sequence of keys is kept, the rest is optional."""
    if [x.key for x in a] == [x.key for x in b]:
        for x, y in zip(a, b):
            _join(x, y, same_pages)
        return a
    out: list[Node] = []
    for x, y in _common([x.key for x in a], [x.key for x in b]):
        if x is not None and y is not None:
            _join(a[x], b[y], same_pages)
        node = b[y] if x is None else a[x]
        node.optional |= x is None or y is None
        _put(out, node)
    return out


def _common(a: list[str], b: list[str]) -> Iterator[tuple[int | None, int | None]]:
    """The places of two sequences in one order, those of a longest common sequence together.

    Two long sequences are halved where a longest common sequence of them can be
    cut, so that memory follows their length.
    """
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            yield a0, b0
            a0, b0 = a0 + 1, b0 + 1
        if (a1 - a0) * (b1 - b0) <= CELLS or a1 - a0 < 2:
            yield from _common_small(a, a0, a1, b, b0, b1)
            continue
        half = (a0 + a1) // 2
        before, after = _common_lengths(a[a0:half], b[b0:b1]), _common_lengths(a[half:a1][::-1], b[b0:b1][::-1])
        cut = b0 + int((before + after[::-1]).argmax())
        todo += [(half, a1, cut, b1), (a0, half, b0, cut)]


def _common_small(a: list[str], a0: int, a1: int, b: list[str], b0: int, b1: int) -> Iterator[tuple[int | None, int | None]]:
    n, m = a1 - a0, b1 - b0
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[a0 + i] == b[b0 + j] else max(best[i + 1][j], best[i][j + 1])
    i, j = 0, 0
    while i < n or j < m:
        if i < n and j < m and a[a0 + i] == b[b0 + j]:
            yield a0 + i, b0 + j
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            yield a0 + i, None
            i += 1
        else:
            yield None, b0 + j
            j += 1


def _common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common sequence of a and each beginning of b, with the cells of a row as the bits of one number."""
    where: dict[str, list[int]] = {}
    for j, key in enumerate(b):
        where.setdefault(key, []).append(j)
    masks = {}
    for key in set(a) & where.keys():
        bits = np.zeros(len(b), np.uint8)
        bits[where[key]] = 1
        masks[key] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << len(b)) - 1
    row = full
    for key in a:
        if mask := masks.get(key):
            met = row & mask
            row = ((row + met) | (row - met)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _fixed(node: Node) -> bool:
    """Whether all text of an item is the same on two pages or more."""
    if node.key == _TEXT:
        return node.text is not None and node.seen > 1
    return any(_all_chars(x) for x in node.below) and all(_fixed(x) for x in node.below if _all_chars(x))


def _all_chars(node: Node, tag: str = "") -> int:
    """Characters of an item over all pages; with a tag, those inside elements of that tag."""
    if node.key == _TEXT:
        return 0 if tag else node.chars
    return sum(_all_chars(x, "" if node.key.split(".")[0] == tag else tag) for x in node.below)


def _surely_furniture(key: str) -> bool:
    """By its element, or by a class all parts of which are words of furniture or of its holders; what is called one comment may be main text."""
    name, *words = key.split(".")
    if name in _FURNITURE_TAGS:
        return True
    if name in ("article", "body", "html", "main"):
        return False
    for word in words:
        parts = word.split("-")
        if word not in _ONE_COMMENT and not _NEVER_MAIN.isdisjoint(parts) and all(x in _NEVER_MAIN or x in _SELDOM_MAIN or x in _HOLDERS for x in parts):
            return True
    return False


def _furniture(node: Node) -> bool:
    """Whether an item is no main text: by its element, by a class that says so as a whole, or by a class word with evidence of the wrapper.

    Evidence is text that is the same on all pages, an item that some pages
    lack, or text that is mostly links; of comments also that there are several.
    Without class words, links that are the same on all pages are furniture.
    """
    name, *words = node.key.split(".")
    if name == "article":  # a reader comment may be an article of its own
        return not _COMMENT_WORDS.isdisjoint(words)
    if _surely_furniture(node.key):
        return True
    if name in ("body", "html", "main"):
        return False
    parts = [w.split("-") for w in words]
    if any(not _ONE_COMMENT.isdisjoint(p) for p in parts) and (node.repeated or any(x.repeated for x in node.below)):
        return True
    named = any(not _SELDOM_MAIN.isdisjoint(p) or not _NEVER_MAIN.isdisjoint((p[0], p[-1])) for p in parts)
    if not named and name != "a" and "a" not in (x.key.split(".")[0] for x in node.below):
        return False
    all_ = _all_chars(node)
    links = all_ and (all_ if name == "a" else _all_chars(node, "a")) > 0.5 * all_
    return bool((links or node.optional or _fixed(node)) if named else (links and not node.optional and _fixed(node) and name != "a"))


def _chars(node: Node) -> int:
    return node.chars if node.key == _TEXT else 0 if _furniture(node) else sum(_chars(x) for x in node.below)


def _innermost(wrapper: list[Node], chars) -> list[Node]:
    """The innermost level that holds most of the text, by the given count of an item's characters."""
    level = wrapper
    while True:
        inner = max((x for x in level if x.key != _TEXT and not _furniture(x)), key=chars, default=None)
        if inner is None or not chars(inner) or chars(inner) < 0.6 * sum(map(chars, level)) or inner.repeated or inner.key.split(".")[0] in ("p", "li", "h1", "h2", "h3"):
            return level
        level = inner.below


def _texts(level: list[Node], sure: bool, varied: bool = False) -> Iterator[Node]:
    """Texts of a level that are main text; varied: without those that are the same on all pages."""
    for x in level:
        if varied and _fixed(x):
            continue
        if x.key == _TEXT:
            yield x
        elif x.key.split(".")[0] == "header":  # of an article's own header, its headings
            if sure:
                yield from _headings(x)
        elif not _furniture(x):
            yield from _texts(x.below, sure, varied)


def _headings(node: Node, inside: bool = False) -> Iterator[Node]:
    for x in node.below:
        if x.key == _TEXT:
            if inside:
                yield x
        elif not _furniture(x):
            yield from _headings(x, inside or x.key.split(".")[0] in ("h1", "h2", "h3", "h4", "h5", "h6"))


def _named_main(node: Node) -> bool:
    return any(not _MAIN_WORDS.isdisjoint((w, w.split("-")[0])) for w in node.key.split(".")[1:])


def mark_main(wrapper: list[Node]) -> list[frozenset]:
    """Give the role of main text to the slots of the wrapper that may hold it.

    A host may have several layouts, so every article or main element is a
    candidate, after them every element named as content, then the innermost
    level that holds most of the other text that varies from page to page (of
    all text, if none varies); within a class the one with most text over all
    pages comes first, of equal ones the first in the page.  A slot's role lists
    its candidates.  The outcome has, for each candidate in this order, the
    candidates that are read with it: articles go with those that have the same
    classes, so teasers do not go with the article.  Inside an
    article or an element named as content a text counts whether or not it is
    equal on all pages; in another level only texts that vary do, if any does.
    """

    def every(nodes: list[Node]) -> Iterator[Node]:
        for x in nodes:
            if x.key != _TEXT and not _furniture(x):
                yield x
                yield from every(x.below)

    elements = list(every(wrapper))
    tags = [x for x in elements if x.key.split(".")[0] in ("article", "main")]
    words = [x for x in elements if x.key.split(".")[0] not in ("article", "main", "body", "html") and _named_main(x)]
    named = {id(x) for x in tags + words}

    def unnamed(node: Node, varied: bool) -> int:
        if node.key == _TEXT:
            return 0 if varied and _fixed(node) else node.chars
        return 0 if id(node) in named or _furniture(node) else sum(unnamed(x, varied) for x in node.below)

    roots = [(x.below, x.key, False) for x in sorted(tags, key=_chars, reverse=True)]
    roots += [(x.below, "", False) for x in sorted(words, key=_chars, reverse=True)]
    varied = any(unnamed(x, True) for x in wrapper)
    roots.append((_innermost(wrapper, lambda x: unnamed(x, varied)), "", varied))
    for k, (level, tag, varied) in enumerate(roots):
        for x in _texts(level, bool(tag), varied):
            x.role += (k,)
    return [frozenset(j for j, (_, other, _) in enumerate(roots) if other == tag) if tag else frozenset([k]) for k, (_, tag, _) in enumerate(roots)]


class Places:
    """Where the items of each key stand in a level."""

    def __init__(self):
        self.known: dict[tuple, list[int]] = {}

    def find(self, nodes: list[Node], key: str, holds: frozenset[str], k: int) -> int | None:
        """The first place of the key whose item has all that `holds` names, from k on or else before; else the first place of the key."""
        places = self._places(nodes, key)
        if not places:
            return None
        if len(places) > 1 and holds:  # layouts in different order
            name = (id(nodes), key, holds)
            if name not in self.known:
                self.known[name] = [i for i in places if holds.issubset(y.key for y in nodes[i].below)]
            places = self.known[name] or places
        at = bisect_left(places, k)
        return places[at] if at < len(places) else places[0]

    def _places(self, nodes: list[Node], key: str) -> list[int]:
        if (id(nodes),) not in self.known:
            self.known[id(nodes),] = []
            for i, x in enumerate(nodes):
                self.known.setdefault((id(nodes), x.key), []).append(i)
        return self.known.get((id(nodes), key), [])


def read_main(items: list, wrapper: list[Node], choices: list[frozenset], places_of: Places | None = None) -> str:
    """The main text of a page read through a wrapper: that of the first candidate which has text on this page."""
    parts: list[tuple[str, Node | None]] = []
    here: set[int] = set()
    places_of = places_of or Places()

    def walk(level: list, nodes: list[Node]) -> None:
        k = 0
        for x in level:
            if x == " ":
                parts.append((" ", None))
                continue
            key = _TEXT if isinstance(x, str) else x[0]
            holds = frozenset() if key == _TEXT else frozenset(_TEXT if isinstance(y, str) else y[0] for y in x[1] if y != " ")
            at = places_of.find(nodes, key, holds, k)
            if at is None:
                continue
            k = max(k, at if key == _TEXT or nodes[at].repeated else at + 1)
            here.add(id(nodes[at]))
            if isinstance(x, str):
                parts.append((html.unescape(x), nodes[at]))
                continue
            block = key.split(".", 1)[0] in _BLOCK
            if block:
                parts.append((" ", None))
            walk(x[1], nodes[at].below)
            if block:
                parts.append((" ", None))

    def chars(node: Node) -> int:
        return 0 if id(node) not in here else node.chars if node.key == _TEXT else 0 if _furniture(node) else sum(map(chars, node.below))

    walk(items, wrapper)
    found = {k for text, node in parts if node is not None and not text.isspace() for k in node.role}
    if found:
        chosen = choices[min(found)]
        kept = [text for text, node in parts if node is None or not chosen.isdisjoint(node.role)]
    else:  # a layout without any candidate: the level that holds most of what this page has
        inside = {id(x) for x in _texts(_innermost(wrapper, chars), False)}
        kept = [text for text, node in parts if node is None or id(node) in inside]
    return " ".join("".join(kept).split())


def _host_wrappers(batches):
    held: dict[str, list] = {}

    def give():
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps([n, [x.pack() for x in w]]) for n, w in held.values()], pa.string())], ["host", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if page is None:
                continue
            level = wrapper_of(nested(page))
            if host in held:
                held[host] = [held[host][0] + 1, align(held[host][1], level)]
            else:
                held[host] = [1, level]
            if len(held) >= HELD_HOSTS:
                yield from give()
                held.clear()
    yield from give()


def _align_group(batches):
    """One wrapper for each run of equal (host, part) of the sorted rows."""
    key, n, level, part_no = None, 0, None, None
    out: list[tuple] = []
    for batch in batches:
        for host, part, packed in zip(batch.column("host").to_pylist(), batch.column("part").to_pylist(), batch.column("wrapper").to_pylist()):
            m, w = json.loads(packed)
            w = [Node.unpack(x) for x in w]
            if (host, part) == key:
                n, level = n + m, align(level, w)
            else:
                if key is not None:
                    out.append((key[0], key[1], json.dumps([n, [x.pack() for x in level]])))
                key, n, level = (host, part), m, w
    if key is not None:
        out.append((key[0], key[1], json.dumps([n, [x.pack() for x in level]])))
    for k in range(0, len(out), 1000):
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out[k : k + 1000]], t) for j, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["host", "part", "wrapper"])


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper): the wrapper of every host, from all its pages."""
    found = settle(pages.select(_host(F.col(url)).alias("host"), F.col(page).alias("html")).mapInArrow(_host_wrappers, "host string, wrapper string"), "wrappers")
    numbered = found.withColumn("part", F.monotonically_increasing_id())
    groups = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    width = 1
    # deal the partial wrappers of a host into groups of about FAN_IN, round by round
    while groups > 1:
        width = max(1, -(-groups // FAN_IN))
        dealt = numbered.withColumn("part", F.pmod(F.xxhash64("wrapper", "part"), F.lit(width)))
        numbered = settle(dealt.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").mapInArrow(_align_group, "host string, part long, wrapper string"), "wrappers")
        groups = width
    return numbered.select("host", "wrapper")


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def extract_main(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row, read through the wrapper of its host.

    A null or empty page gives an empty text.  Pages without a host in their url
    share one wrapper.  Repeated pages and ids give a row each; other columns are
    not read.  Wrappers of up to WRAPPER_BYTES in all are broadcast, so pages are
    not shuffled; more are joined with salted hosts.  Character references are decoded, white space in a block
    becomes one space, and blocks are joined by one space in page order.
    """
    known = infer_wrappers(pages, url, page)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"), _host(F.col(url)).alias("host"))
    schema = f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long"
    size = known.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if size <= WRAPPER_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in known.collect()})

        def read(batches):
            readers: dict[str, _Reader] = {}
            for batch in batches:
                yield _read_batch(batch, ((host, shared.value.get(host)) for host in batch.column("host").to_pylist()), readers)

        return rows.mapInArrow(read, schema)
    # a host's pages are spread over SALTS keys, and its wrapper goes to each
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["host", "salt"], "left")

    def read_joined(batches):
        readers: dict[str, _Reader] = {}
        for batch in batches:
            yield _read_batch(batch, zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()), readers)

    return joined.mapInArrow(read_joined, schema)


class _Reader:
    """A wrapper made ready to read pages."""

    def __init__(self, packed: str):
        self.wrapper = [Node.unpack(x) for x in json.loads(packed)[1]]
        self.choices, self.places = mark_main(self.wrapper), Places()

    def read(self, page: str) -> str:
        return read_main(nested(page), self.wrapper, self.choices, self.places)


def _read_batch(batch: pa.RecordBatch, wrappers: Iterator[tuple[str, str | None]], readers: dict[str, _Reader]) -> pa.RecordBatch:
    texts = []
    for page, (host, packed) in zip(batch.column("html").to_pylist(), wrappers):
        if not page or packed is None:
            texts.append("")
            continue
        if host not in readers:
            if len(readers) >= HELD_HOSTS:
                readers.clear()
            readers[host] = _Reader(packed)
        texts.append(readers[host].read(page))
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of pages."""
    return extract_main(table(spark, sf_dir, "pages"))
