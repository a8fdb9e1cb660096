"""Phrase collocation mining (operator 11) by vertical positional inverted lists.

Documents are dealt into segments.  A segment is an inverted index: its words
with the list of positions at which each stands.  A phrase's occurrence list is
got from shorter ones: the positions of a frequent phrase are merged with the
postings of the word behind it, and the length of the list is the phrase's exact
frequency in the segment.  No phrase crosses a piece, so none crosses segments,
and frequencies add up over segments.

Level by level, the segments send the keys and lengths of their new lists; those
that are frequent over all segments are named to the segments that hold them, and
only lists of those are kept and extended.  A word is reached only through the
frequent phrase that starts one word later and ends with it, so no list is made
that a shorter phrase rules out.  Single words are not ruled out first: nearly
all occurrences are of frequent words, and to name these to the segments would
cost more than the pairs it saves.  A key is 80 bits of hashes of the phrase; the
first segment that holds it gives the phrase and its frequency.

What is shuffled are counts of words, one row for each word and segment, and
keys, one row for each list and segment.  The lists lie where they were made,
dealt by segment.  Nothing is broadcast or collected but the places of the
partitions of the last sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataline.llm import textkit as K
from strataline.llm.shared import discard, numbered, settle, settle_dealt, table

MOST_WORDS = 4
LEAST = 30
TOP = 2_000
COVER_PERCENT = 80
SEGMENT_WORDS = 1 << 20
_NUMBER_BITS = 26  # of a list in its segment; above it 12 bits of the segment in its task, then the task

_ENDS_PIECE = np.zeros(256, dtype=bool)
_ENDS_PIECE[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_IN_WORD = ~_ENDS_PIECE
_IN_WORD[[ord(" "), ord("\t")]] = False
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_TWIST = np.uint64(0x2545F4914F6CDD1D)

_LISTS = "seg long, langs array<string>, terms array<string>, term_lang array<int>, counts array<long>, positions binary"
_WORDS = _LISTS + ", lang_words array<long>"  # all words of a segment; their keys follow from them
_OWN = _LISTS + ", keys array<long>, checks array<int>, own_lang array<string>, own_phrase array<string>, own_f array<long>"  # frequent phrases, and those that the segment gives
_NAMES = ["seg", "langs", "terms", "term_lang", "counts", "positions"]


def _packed(lists: np.ndarray, counts: np.ndarray) -> bytes:
    """Positions by term as differences; the first of each list stands whole."""
    first = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)
    step = np.diff(lists, prepend=0)
    step[first] = lists[first]
    return pa.compress(step.astype(np.uint32).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, counts: np.ndarray) -> np.ndarray:
    n = int(counts.sum())
    step = np.frombuffer(pa.decompress(data, n * 4, "zstd", asbytes=True), np.uint32).astype(np.int64)
    total = np.cumsum(step)
    first = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)
    return total - np.repeat(total[first] - step[first], counts)


def _chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes, text bounds and first row of parts of about a megabyte; long texts are cut where a piece ends."""
    for a, b in K.pieces(offsets):
        start, stop = int(offsets[a]), int(offsets[b])
        while b - a == 1 and stop - start > 2 * K.PIECE_BYTES:
            ends = np.flatnonzero(_ENDS_PIECE[data[start + K.PIECE_BYTES : start + 2 * K.PIECE_BYTES]])
            if not len(ends):
                ends = np.flatnonzero(_ENDS_PIECE[data[start + K.PIECE_BYTES : stop]])[:1]
            if not len(ends):
                break
            cut = start + K.PIECE_BYTES + int(ends[0]) + 1
            yield data[start:cut], np.zeros(1, np.int64), a
            start = cut
        yield data[start:stop], np.maximum(offsets[a:b] - start, 0), a


def _salts(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


def _word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return K.mix(K.word_hashes(data, starts, ends) ^ salt)


def _word_checks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Hashes of 16 bits by other values of the bytes."""
    return K.mix(K.span_hash(K.prefix_sums(K.mix(K.byte_values(data) ^ _TWIST)), starts, ends) ^ salt).astype(np.uint16)


class _Segment:
    """The words of some documents, gathered until there are enough for an index."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.n, self.next = 0, 0
        self.keys: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.known: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []  # key, language and word of the distinct words of a part

    def add(self, data: np.ndarray, bounds: np.ndarray, langs: list[str]) -> None:
        low = K.lower(data)
        starts, ends, owner = K.runs(_IN_WORD[low], bounds)
        if not len(starts):
            return
        number = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)
        keys = _word_keys(low, starts, ends, _salts(langs)[owner])
        breaks = np.r_[0, np.cumsum(_ENDS_PIECE[low])]
        apart = (breaks[starts[1:]] > breaks[ends[:-1]]) | (owner[1:] != owner[:-1])
        at = self.next + np.arange(len(starts)) + np.r_[0, np.cumsum(apart)]
        self.next = int(at[-1]) + 2
        self.n += len(starts)
        self.keys.append(keys)
        self.at.append(at.astype(np.int32))
        _, first = np.unique(keys, return_index=True)
        first.sort()
        size = ends[first] - starts[first]
        inside = np.zeros(len(low) + 1, np.int8)
        inside[starts[first]] += 1
        inside[ends[first]] -= 1
        text = low[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        offs = np.r_[0, np.cumsum(size)].astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(text.tobytes())])
        self.known.append((keys[first], number[owner[first]], words))

    def index(self, seg: int) -> pa.RecordBatch:
        keys, at = np.concatenate(self.keys), np.concatenate(self.at)
        some, first = np.unique(np.concatenate([k for k, _, _ in self.known]), return_index=True)
        lang = np.concatenate([x for _, x, _ in self.known])[first]
        words = pa.concat_arrays([w for _, _, w in self.known]).take(pa.array(first)).cast(pa.string())
        term = np.searchsorted(some, keys)
        order = np.argsort(term, kind="stable")
        counts = np.bincount(term, minlength=len(some))
        words_of = np.bincount(lang, weights=counts, minlength=len(self.langs)).astype(np.int64)
        return pa.RecordBatch.from_arrays([*_list_columns(seg, list(self.langs), words, lang, counts, at[order].astype(np.int64)), _one(pa.array(words_of))], [*_NAMES, "lang_words"])


def _one(values: pa.Array) -> pa.Array:
    """A column of one row, which holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _list_columns(seg: int, langs: list[str], terms: pa.Array, term_lang: np.ndarray, counts: np.ndarray, positions: np.ndarray) -> list[pa.Array]:
    lists = [pa.array(langs, pa.string()), terms, pa.array(term_lang.astype(np.int32)), pa.array(counts.astype(np.int64))]
    return [pa.array([seg]), *map(_one, lists), pa.array([_packed(positions, counts)], pa.binary())]


def _segment_number(task: int, made: int) -> int:
    if made >> 12:
        raise ValueError("a task has too many segments; give a larger number of words")
    return task << 12 | made


def _segments(most: int):
    def run(batches):
        task, made, open_ = TaskContext.get().partitionId(), 0, _Segment()
        for batch in batches:
            data, offsets, _ = K.column_bytes(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            for part, bounds, row in _chunks(data, offsets):
                open_.add(part, bounds, langs[row : row + len(bounds)])
                if open_.n >= most:
                    yield open_.index(_segment_number(task, made))
                    made, open_ = made + 1, _Segment()
        if open_.n:
            yield open_.index(_segment_number(task, made))

    return run


class _Lists:
    """A segment's occurrence lists."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        get = lambda name: batch.column(name)[row].values
        self.seg, self.langs, self.terms = batch.column("seg")[row].as_py(), batch.column("langs")[row].as_py(), get("terms")
        self.lang, self.counts = np.asarray(get("term_lang")), np.asarray(get("counts"))
        if "keys" in batch.schema.names:
            self.keys, self.checks = np.asarray(get("keys")).view(np.uint64), np.asarray(get("checks")).astype(np.uint16)
        else:
            data, ends, _ = K.column_bytes(self.terms)
            salt = _salts(self.langs)[self.lang]
            self.keys, self.checks = (f(data, ends[:-1], ends[1:], salt) for f in (_word_keys, _word_checks))
        self.positions = _unpacked(batch.column("positions")[row].as_py(), self.counts)

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each position at which a phrase stands and one more a word later, with the numbers of both.

        Both lists are in the order of positions on one axis, so they are merged
        by going along it.
        """
        axis = np.full(int(self.positions.max(initial=0)) + 2, -1, np.int32)
        axis[self.positions] = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        at = np.flatnonzero((axis[:-1] >= 0) & (axis[1:] >= 0))
        return at, axis[at], axis[at + 1]

    def longer(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and check of the phrases one word longer."""
        keys = K.mix(self.keys[left] * _FOLD + self.keys[right])
        checks = K.mix((self.checks[left].astype(np.uint64) << np.uint64(32)) + self.checks[right]) ^ K.mix(keys * _TWIST)
        return keys, checks.astype(np.uint16)


def _kept(batch: pa.RecordBatch, row: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of a segment's n lists are kept, and the frequencies of those whose phrases it gives (0 for others)."""
    on, f = np.zeros(n, bool), np.zeros(n, np.int64)
    on[np.asarray(batch.column("kept")[row].values)] = True
    own = batch.column("own")[row].values
    f[np.asarray(own.field("number"))] = np.asarray(own.field("f"))
    return on, f


def _longer_keys(batches):
    """Place, key, and length and check (16 bits) of the list of every phrase that is one word longer."""
    for batch in batches:
        for row in range(batch.num_rows):
            lists = _Lists(batch, row)
            _, left, right = lists.merge()
            pair, n = np.unique(left.astype(np.int64) * len(lists.keys) + right, return_counts=True)
            if len(pair) >> _NUMBER_BITS:
                raise ValueError("a segment has too many lists; give a smaller number of words")
            for k in range(0, len(pair), 1 << 17):
                part = pair[k : k + (1 << 17)]
                keys, checks = lists.longer(part // len(lists.keys), part % len(lists.keys))
                place = (lists.seg << _NUMBER_BITS) + np.arange(k, k + len(part))
                rest = (n[k : k + (1 << 17)] << 16) + checks
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(keys.view(np.int64)), pa.array(rest)], ["place", "key", "rest"])


def _kept_row(lists: _Lists, f: np.ndarray, terms: pa.Array, lang: np.ndarray, keys: np.ndarray, checks: np.ndarray, counts: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    own = np.flatnonzero(f)
    given = [pa.array([lists.langs[k] for k in lang[own].tolist()], pa.string()), terms.take(pa.array(own)), pa.array(f[own])]
    hashes = [pa.array(keys.view(np.int64)), pa.array(checks.astype(np.int32))]
    return pa.RecordBatch.from_arrays([*_list_columns(lists.seg, lists.langs, terms, lang, counts, positions), *map(_one, hashes + given)], [*_NAMES, "keys", "checks", "own_lang", "own_phrase", "own_f"])


def _kept_phrases(batches):
    """The lists of frequent phrases that are one word longer."""
    for batch in batches:
        for row in range(batch.num_rows):
            lists = _Lists(batch, row)
            at, left, right = lists.merge()
            pair, number, counts = np.unique(left.astype(np.int64) * len(lists.keys) + right, return_inverse=True, return_counts=True)
            on, f = _kept(batch, row, len(pair))
            here = np.flatnonzero(on[number])
            here = here[np.argsort(number[here], kind="stable")]  # by phrase, in the order of positions
            pair, counts = pair[on], counts[on]
            left, right = pair // len(lists.keys), pair % len(lists.keys)
            keys, checks = lists.longer(left, right)
            last = pa.array([x.rpartition(" ")[2] for x in lists.terms.take(pa.array(right)).to_pylist()], pa.string())
            terms = pc.binary_join_element_wise(lists.terms.take(pa.array(left)), last, " ")
            yield _kept_row(lists, f[on], terms, lists.lang[left], keys, checks, counts, at[here])


def _frequent(keys: DataFrame, least: int) -> DataFrame:
    """(seg, kept, own): of rows (place, key, rest), the numbers of each segment whose keys have a length of `least` or more over all segments.

    own: the number and length over all segments of the keys whose phrase the
    segment gives, which are those that no earlier segment has.
    """
    same = Window.partitionBy("key", "check")
    rows = keys.repartition("key").select("place", "key", F.col("rest").bitwiseAND((1 << 16) - 1).alias("check"), F.shiftright("rest", 16).alias("n"))
    total = rows.withColumns({"f": F.sum("n").over(same), "first": F.min("place").over(same)}).where(F.col("f") >= least)
    number = F.col("place").bitwiseAND((1 << _NUMBER_BITS) - 1).cast("int").alias("number")
    own = F.when(F.col("place") == F.col("first"), F.struct(number, "f"))
    return total.groupBy(F.shiftright("place", _NUMBER_BITS).alias("seg")).agg(F.collect_list(number).alias("kept"), F.collect_list(own).alias("own"))


def _given(lists: DataFrame, words: int) -> DataFrame:
    """(lang, phrase, words, f) of the phrases that the segments give: each once."""
    own = lists.select(F.explode(F.arrays_zip("own_lang", "own_phrase", "own_f")).alias("x"))
    return settle(own.select(F.col("x.own_lang").alias("lang"), F.col("x.own_phrase").alias("phrase"), F.lit(words).alias("words"), F.col("x.own_f").alias("f")), "phrases")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST, segment_words: int = SEGMENT_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to most_words words that occur `least` times or more in their language, and (lang, n) of all words.

    Texts are lower-cased in A-Z, cut into pieces at . , ; : ! ? and line ends,
    and these into words at spaces and tabs.  A null lang is `und`; null and empty
    texts have no words; repeated rows count again; no other column is read.
    Empty tables give empty tables.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    whole = settle_dealt(rows.mapInArrow(_segments(segment_words), _WORDS), "words", "seg")
    totals = settle(whole.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.lang_words").alias("n")), "totals")
    each = whole.select("langs", F.explode(F.arrays_zip("terms", "term_lang", "counts")).alias("x")).select(F.element_at("langs", F.col("x.term_lang") + 1).alias("lang"), F.col("x.terms").alias("phrase"), F.col("x.counts").alias("n"))
    one = each.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    names = _NAMES
    found, lists = settle(one.select("lang", "phrase", F.lit(1).alias("words"), "f"), "phrases"), whole
    for words in range(2, most_words + 1):
        kept = _frequent(lists.select(*names).mapInArrow(_longer_keys, "place long, key long, rest long"), least)
        lists = settle_dealt(lists.select(*names).join(kept.hint("shuffle_hash"), "seg").mapInArrow(_kept_phrases, _OWN), "lists", "seg", spent=(lists,))
        found, names = found.unionByName(_given(lists, words)), [*_NAMES, "keys", "checks"]
    discard(lists)
    return found, totals


def _parts(name: str, first, size) -> F.Column:
    return F.array_join(F.slice(name, first, size), " ")


def score_phrases(phrases: DataFrame, cover_percent: int = COVER_PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words and more that no longer one covers.

    l and r are the frequencies of the parts at the cut with the least score,
    floor(2000000 a / (l + r)), the first of equal ones.  A phrase goes if some
    longer one that holds it has cover_percent or more of its frequency.
    """
    part = phrases.select("lang", "phrase", "f")
    long_ = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = long_.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select("lang", "phrase", "a", "cut", _parts("w", F.lit(1), F.col("cut")).alias("before"), _parts("w", F.col("cut") + 1, F.col("words") - F.col("cut")).alias("after"))
    both = cut.join(part.select("lang", F.col("phrase").alias("before"), F.col("f").alias("l")), ["lang", "before"]).join(part.select("lang", F.col("phrase").alias("after"), F.col("f").alias("r")), ["lang", "after"])
    # a decimal of 38 digits holds the product
    scored = both.withColumn("score", F.expr("CAST((CAST(a AS decimal(20,0)) * 2000000) div (CAST(l AS decimal(20,0)) + r) AS bigint)"))
    best = scored.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("at"))
    inner = long_.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("first", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    covers = inner.groupBy("lang", _parts("w", F.col("first"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longest"))
    free = best.join(covers, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < cover_percent * F.col("a")))
    return free.select("lang", "phrase", "a", "at.l", "at.r", "at.score")


def top_collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST, top: int = TOP, cover_percent: int = COVER_PERCENT, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` phrases by score, then a, then the phrase's bytes."""
    phrases, totals = frequent_phrases(docs, text, lang, most_words, least, segment_words)
    ranked = numbered(score_phrases(phrases, cover_percent), [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], "rank", "ranked", by=("lang",)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's first 2,000 phrases of each language of documents."""
    return top_collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH piece AS (
  SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^ \t]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
gram AS (
  SELECT lang, words, array_to_string(w[k:k + words - 1], ' ') AS phrase
  FROM (SELECT lang, w, words, unnest(range(1, len(w) - words + 2)) AS k FROM piece, (SELECT unnest([1, 2, 3, 4]) AS words) WHERE len(w) >= words)),
total AS (SELECT lang, count(*) AS n FROM gram WHERE words = 1 GROUP BY lang),
f AS (SELECT lang, words, phrase, count(*) AS f FROM gram GROUP BY lang, words, phrase HAVING count(*) >= 30),
candidate AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
cut AS (SELECT *, unnest(range(1, words)) AS c FROM candidate),
scored AS (
  SELECT cut.lang, cut.phrase, cut.words, cut.a, c, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * cut.a) // (x.f + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:c], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[c + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_part AS (
  SELECT lang, array_to_string(w[k:k + size - 1], ' ') AS phrase, max(a) AS longest
  FROM (SELECT lang, w, a, size, unnest(range(1, words - size + 2)) AS k FROM (SELECT *, unnest(range(2, words)) AS size FROM candidate WHERE words > 2)) GROUP BY ALL),
ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM best LEFT JOIN inner_part USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
