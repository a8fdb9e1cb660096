"""Language identification (operator 5): known words first, shorter and shorter n-grams for the rest.

The model holds counts by language of words and of character n-grams, over the
whole corpus and without a cut.  A word is known, and so is an n-gram, if some
language has it once.  A word that is not known is read by the longest known
n-gram that ends at each of its characters.

The counts are a table in the shared folder.  Its frequent part is broadcast:
the keys that make up `share` or more of the counts of their order, so that the
words left over grow with the input, and of those the most frequent that have
`most` entries (of a key and a language) together, which bounds it whatever the
corpus and the number of languages.  All other words are looked up by joins, and
of the words the table has not, the n-grams.  Both figures move work between the
two ways and change no result.

A frequency counts above the floor, half of one occurrence in the largest
language: the floor itself adds alike to all languages.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import textkit as K
from strataline.llm.shared import crc_mod, settle, table

ORDERS = (4, 3, 2, 1)
SHARE = 1e-7
MOST = 1 << 20
_STEPS = 8  # of a doubling of counts
UNKNOWN = "und"
HELD_KEYS = 4 << 20


def _letter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = [chr(i) for i in range(0x110000)]
    letter = np.array([c.isalpha() for c in points])
    inner = letter | np.array([unicodedata.category(c)[0] == "M" for c in points])
    low = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        c = points[i].lower()
        if len(c) == 1:
            low[i] = ord(c)
    return letter, inner, low


_tables: list = []


def letters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, and start, end and text number of the words: runs of letters and the marks on them."""
    if not _tables:
        _tables.extend(_letter_tables())
    letter, inner, low = _tables
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][bounds]
    starts, ends, owner = K.runs(inner[points], place)
    seen = np.r_[0, np.cumsum(letter[points])]
    real = seen[ends] > seen[starts]
    return low[points], starts[real], ends[real], owner[real]


def word_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return K.span_hash(K.prefix_sums(K.mix(points.astype(np.uint64))), starts, ends)


def framed(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after the other, each with a blank before and behind; and the word of each place."""
    size = ends - starts + 2
    word = np.repeat(np.arange(len(starts)), size)
    at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    inner = (at > 0) & (at < size[word] - 1)
    out = np.zeros(len(word), np.uint32)
    out[inner] = points[(starts[word] + at - 1)[inner]]
    return out, word


def gram_keys(seq: np.ndarray, word: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Last place and key of each n-gram inside one framed word; a blank alone is none."""
    if len(seq) < order:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = np.full(len(seq) - order + 1, order, np.uint64)
    for k in range(order):
        key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + seq[k : len(seq) - order + 1 + k])
    ok = word[order - 1 :] == word[: len(word) - order + 1]
    if order == 1:
        ok = ok & (seq > 0)
    first = np.flatnonzero(ok)
    return first + order - 1, key[first]


def _counts(batches):
    """(lang, order, key, n) with order 0 for words, summed over many texts of a task."""
    held: dict[tuple[str, int], list[np.ndarray]] = {}
    n = 0

    def give():
        for (lang, order), parts in held.items():
            keys, count = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(keys), np.int64))), pa.array(np.full(len(keys), order, np.int32)), pa.array(keys.view(np.int64)), pa.array(count)], ["lang", "ord", "key", "n"])

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        data, offsets, _ = K.column_bytes(batch.column("text"))
        for a, b in K.pieces(offsets):
            points, starts, ends, owner = letters(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a])
            keys = word_keys(points, starts, ends)
            of = langs[a:b][owner]
            for lang in set(langs[a:b]):
                mine = of == lang
                seq, word = framed(points, starts[mine], ends[mine])
                parts = {0: keys[mine]} | {order: gram_keys(seq, word, order)[1] for order in ORDERS}
                for order, part in parts.items():
                    held.setdefault((lang, order), []).append(part)
                    n += len(part)
            if n > HELD_KEYS:
                yield from give()
                held, n = {}, 0
    yield from give()


class Frequent:
    """The frequent keys of each order: for each the languages that have it and their log frequencies above the floor."""

    def __init__(self, langs: list[str], rows: pa.Table, logs: dict[tuple[str, int], float]):
        self.langs = langs
        self.parts: dict[int, tuple[K.HashTable, np.ndarray, np.ndarray, np.ndarray]] = {}
        order, key, n = (np.asarray(rows.column(c).combine_chunks()) for c in ("ord", "key", "n"))
        lang = np.searchsorted(langs, rows.column("lang").to_pylist()) if rows.num_rows else np.zeros(0, int)
        for o in (0, *ORDERS):
            mine = np.flatnonzero(order == o)
            mine = mine[np.argsort(key[mine], kind="stable")]
            keys, first = np.unique(key[mine], return_index=True)
            base = np.array([logs.get((x, o), 0.0) for x in langs])
            gain = np.log(n[mine]) + base[lang[mine]] if len(mine) else np.zeros(0)
            self.parts[o] = (K.HashTable(keys.view(np.uint64)), np.r_[first, len(mine)], lang[mine].astype(np.int16), (gain / max(o, 1)).astype(np.float32))

    def find(self, order: int, keys: np.ndarray) -> np.ndarray:
        return self.parts[order][0].find(keys)

    def add(self, total: np.ndarray, owner: np.ndarray, order: int, row: np.ndarray) -> None:
        """Add the gains of the keys at `row` to the languages of their owners."""
        _, first, lang, gain = self.parts[order]
        size = first[row + 1] - first[row]
        at = np.repeat(first[row] - np.cumsum(size) + size, size) + np.arange(size.sum())
        where = np.repeat(owner, size) * len(self.langs) + lang[at]
        total += np.bincount(where, weights=gain[at], minlength=total.size).reshape(total.shape)


@dataclass
class LanguageModel:
    """Languages, frequent keys, and the tables of all counts (ord, key, by, n) and of log floors (lang, ord, no, base)."""

    langs: list[str]
    frequent: Frequent
    counts: DataFrame
    floors: DataFrame


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = SHARE, most: int = MOST) -> LanguageModel:
    """Counts over all rows of docs with a text and a language; repeated rows count as often as they stand there."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(_counts, "lang string, ord int, key long, n long").groupBy("lang", "ord", "key").agg(F.sum("n").alias("n"))
    counts = settle(sums.groupBy("ord", "key").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("n")), "language-counts")
    # one row for each language and order
    totals = {(r.lang, r.ord): r.n for r in counts.select("ord", F.inline("by")).groupBy("lang", "ord").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({x for x, _ in totals})
    logs = {(x, o): float(np.log(2.0 * max(m for (_, p), m in totals.items() if p == o) / n)) for (x, o), n in totals.items()}
    step = F.floor(F.log2("n") * _STEPS)
    # at most 64 * _STEPS rows for each order
    sizes = sorted(counts.groupBy("ord", step.alias("step")).agg(F.sum(F.size("by")).alias("entries")).collect(), key=lambda r: -r.step)
    taken, lowest = dict.fromkeys((0, *ORDERS), 0), {}
    for r in sizes:
        taken[r.ord] += r.entries
        if taken[r.ord] <= most:
            lowest[r.ord] = r.step
    often = F.lit(False)
    for o, least in lowest.items():
        total = sum(n for (_, p), n in totals.items() if p == o)
        often = often | ((F.col("ord") == o) & (step >= least) & (F.col("n") >= share * total))
    often = counts.where(often).select("ord", "key", F.inline("by")).toArrow()
    floors = spark.createDataFrame([(x, o, langs.index(x), base) for (x, o), base in logs.items()], "lang string, ord int, no int, base double")
    return LanguageModel(langs, Frequent(langs, often, logs), counts, floors)


def _spelled(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    at = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())
    chars = points[at].astype("<u4").tobytes().decode("utf-32-le")
    stop = np.cumsum(size)
    return pa.array([chars[i:j] for i, j in zip((stop - size).tolist(), stop.tolist())], pa.string())


def _read(frequent: Frequent, data: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """For each text its words, the gains of its frequent words by language, and its other words with their numbers."""
    points, starts, ends, owner = letters(data, bounds)
    texts = len(bounds) - 1
    total = np.zeros((texts, len(frequent.langs)))
    keys = word_keys(points, starts, ends)
    row = frequent.find(0, keys)
    often = row >= 0
    frequent.add(total, owner[often], 0, row[often])
    at = np.flatnonzero(~often)
    at = at[np.lexsort((keys[at], owner[at]))]
    new = np.r_[True, (keys[at][1:] != keys[at][:-1]) | (owner[at][1:] != owner[at][:-1])] if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    one = at[first]
    rare = pa.StructArray.from_arrays([pa.array(keys[one].view(np.int64)), pa.array(np.diff(np.r_[first, len(at)])), _spelled(points, starts[one], ends[one])], ["key", "n", "word"])
    lists = np.r_[0, np.cumsum(np.bincount(owner[one], minlength=texts))].astype(np.int32)
    width = np.arange(texts + 1, dtype=np.int32) * len(frequent.langs)
    return [pa.array(np.bincount(owner, minlength=texts).astype(np.int64)), pa.ListArray.from_arrays(width, total.ravel()), pa.ListArray.from_arrays(lists, rare)]


def _read_unseen(frequent: Frequent, data: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """For each word the gains of places whose longest n-gram is frequent, and the n-grams to look up for the others.

    Those are, for each place, all that are longer than its longest frequent
    one, and that one.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    cut = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][bounds]
    words = len(bounds) - 1
    total = np.zeros((words, len(frequent.langs)))
    seq, word = framed(points, cut[:-1], cut[1:])
    open_, asked = np.ones(len(seq), bool), np.zeros(len(seq), bool)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for order in ORDERS:
        last, keys = gram_keys(seq, word, order)
        live = open_[last]
        last, keys = last[live], keys[live]
        row = frequent.find(order, keys)
        often = row >= 0
        now = often & ~asked[last]
        frequent.add(total, word[last[now]], order, row[now])
        found.append((last[~now], np.full((~now).sum(), order, np.int32), keys[~now].view(np.int64)))
        asked[last[~often]] = True
        open_[last[often]] = False
    place, order, keys = (np.concatenate(x) for x in zip(*found))
    by = np.argsort(word[place], kind="stable")
    grams = pa.StructArray.from_arrays([pa.array(place[by].astype(np.int64)), pa.array(order[by]), pa.array(keys[by])], ["place", "ord", "gram"])
    lists = np.r_[0, np.cumsum(np.bincount(word[place], minlength=words))].astype(np.int32)
    width = np.arange(words + 1, dtype=np.int32) * len(frequent.langs)
    return [pa.ListArray.from_arrays(width, total.ravel()), pa.ListArray.from_arrays(lists, grams)]


def _over(docs: DataFrame, column: str, carry: str, read, names: list[str], schema: str, model: LanguageModel) -> DataFrame:
    """read(frequent, bytes, bounds) of a text column, piece by piece, beside the column `carry`."""
    shared = docs.sparkSession.sparkContext.broadcast(model.frequent)

    def run(batches):
        for batch in batches:
            data, offsets, _ = K.column_bytes(batch.column(column))
            for a, b in K.pieces(offsets):
                got = read(shared.value, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(carry).slice(a, b - a), *got], [carry, *names])

    return docs.select(carry, column).mapInArrow(run, schema)


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; `und` with score 0 where there is no letter or nothing was learned.

    The score is the share of the best language when the likelihoods of all are
    set to sum to one.  Ties go to the first language by name.  Null and empty
    texts are `und`; repeated rows, ids and null ids each keep their rows.
    """
    asked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if not model.langs:
        return asked.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    read = _over(asked, "text", "doc_id", _read, ["words", "gains", "rare"], "doc_id long, words long, gains array<double>, rare array<struct<key: long, n: long, word: string>>", model)
    read = settle(read.withColumn("row", F.monotonically_increasing_id()), "language-words")
    rare = read.select("row", F.inline("rare"))
    names = rare.select("key", "word").distinct()
    floors = F.broadcast(model.floors)  # one row for each language and order

    counts = model.counts.where("ord = 0").select("key", "by")
    names = settle(names.join(counts, "key", "left").select("key", F.when(F.col("by").isNull(), F.col("word")).alias("word"), "by"), "language-lookup")
    known = names.where("by is not null").select("key", F.lit(0).alias("ord"), F.inline("by")).join(floors, ["lang", "ord"])
    known = known.select("key", "no", (F.log("n") + F.col("base")).alias("gain"))
    unseen = _over(names.where("by is null"), "word", "key", _read_unseen, ["gains", "grams"], "key long, gains array<double>, grams array<struct<place: long, ord: int, gram: long>>", model)
    unseen = settle(unseen, "language-unseen")
    near = unseen.select("key", F.posexplode("gains").alias("no", "gain")).where("gain > 0")
    grams = model.counts.where("ord > 0").select("ord", F.col("key").alias("gram"), "by")
    # the longest known n-gram at each place of a word
    far = unseen.select("key", F.inline("grams")).join(grams, ["ord", "gram"]).groupBy("key", "place").agg(F.max_by("by", "ord").alias("by"), F.max("ord").alias("ord"))
    far = far.select("key", "ord", F.inline("by")).join(floors, ["lang", "ord"]).select("key", "no", ((F.log("n") + F.col("base")) / F.col("ord")).alias("gain"))

    gains = known.unionByName(near).unionByName(far).groupBy("key", "no").agg(F.sum("gain").alias("gain"))
    more = rare.select("row", "key", "n").join(gains, "key").groupBy("row", "no").agg(F.sum(F.col("n") * F.col("gain")).alias("gain"))
    more = more.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("no", "gain"))).alias("more"))
    total = F.transform("gains", lambda x, i: x + F.coalesce(F.try_element_at("more", i), F.lit(0.0)))
    out = read.select("row", "doc_id", "words", "gains").join(more, "row", "left").select("doc_id", "words", total.alias("total"))
    best = F.array_max("total")
    share = 1.0 / F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp(x - best))
    name = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("total", best).cast("int"))
    return out.select("doc_id", F.when(F.col("words") > 0, name).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("words") > 0, share).otherwise(0.0).alias("score"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's predictions; a row with a null id is learned from and belongs to no held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    found = identify(docs, fit_languages(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
