"""Benchmark decontamination (operator 1).

The word windows of the benchmark form a hash set that is broadcast to the
tasks scanning the training documents.  Every hit is verified word by word.
The set is broadcast only when the benchmark's bytes are within a stated
bound; a larger benchmark is taken in blocks of items, each within the bound,
one after the other.  Each block scans the documents once, and the blocks'
findings meet in one aggregation: there is one verdict over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import textkit as K
from strataline.llm.shared import set_aside, settle, table

WINDOW_WORDS = 13
BENCHMARK_BYTES = 24 << 20  # a block's set takes about seven times this in each Python worker, and is sent as twice this
_SPAN_FIELDS = ("start", "end", "first", "last")
_SPANS = pa.list_(pa.struct([(x, pa.int64()) for x in _SPAN_FIELDS]))


class BenchmarkWindows:
    """Hash set of the windows of benchmark items, with the words to verify a hit.

    All words stand in one byte buffer, each with a space behind.  A set has, for
    each window size, its distinct hashes and the places (first words) of each;
    a place tells both the words and the item.
    """

    def __init__(self, item_ids: list, texts: list, window: int = WINDOW_WORDS):
        data, offsets, _ = K.column_bytes(pa.array(texts, pa.large_string()))
        low, starts, ends, owner = K.words(data, offsets[:-1] if len(texts) else np.zeros(1, np.int64))
        self.names, self.window = [str(x) for x in item_ids], window
        self.buffer, self.word_at = spaced(low, starts, ends)
        self.item = owner.astype(np.int32)
        self._index()

    def __reduce__(self):
        return BenchmarkWindows._read, (self.names, self.window, self.buffer, self.word_at, self.item)

    @staticmethod
    def _read(*parts) -> BenchmarkWindows:
        out = BenchmarkWindows.__new__(BenchmarkWindows)
        out.names, out.window, out.buffer, out.word_at, out.item = parts
        out._index()
        return out

    def _index(self) -> None:
        self.by_size: dict[int, tuple[K.PackedTable, np.ndarray, np.ndarray]] = {}
        count = np.bincount(self.item, minlength=len(self.names))
        hashes = K.word_hashes(self.buffer, self.word_at[:-1].astype(np.int64), self.word_at[1:].astype(np.int64) - 1)
        for size in np.unique(np.minimum(count[count > 0], self.window)).tolist():
            mine = np.flatnonzero((count[self.item] >= size) if size == self.window else (count[self.item] == size))
            first, h = K.window_hashes(hashes[mine], self.item[mine], size)
            order = np.argsort(h, kind="stable")
            new = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
            self.by_size[size] = (K.PackedTable(h[order][new]), np.r_[new, len(h)].astype(np.int32), mine[first[order]].astype(np.int32))

    def hits(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words stand in a verified window, and the items found in each text."""
        change = np.zeros(len(starts) + 1, dtype=np.int32)
        items: dict[int, set[int]] = {}
        hashes, own = K.word_hashes(low, starts, ends), None
        for size, (keys, cuts, places) in self.by_size.items():
            first, h = K.window_hashes(hashes, owner, size)
            row = keys.find(h)
            found = np.flatnonzero(row >= 0)
            if len(found) and own is None:
                own, own_at = spaced(low, starts, ends)
            for i, r in zip(first[found].tolist(), row[found].tolist()):
                said = own[own_at[i] : own_at[i + size]].tobytes()
                same = [int(self.item[p]) for p in places[cuts[r] : cuts[r + 1]].tolist() if self.buffer[self.word_at[p] : self.word_at[p + size]].tobytes() == said]
                if same:
                    change[i] += 1
                    change[i + size] -= 1
                    items.setdefault(int(owner[i]), set()).update(same)
        return np.cumsum(change[:-1]) > 0, items


def spaced(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words in one buffer, each with a space behind, and where each starts (and the last ends)."""
    size = ends - starts + 1
    at = np.r_[0, np.cumsum(size)]
    from_ = np.repeat(starts - at[:-1], size) + np.arange(at[-1])
    out = low[np.minimum(from_, max(len(low) - 1, 0))] if len(low) else np.zeros(0, np.uint8)
    out[at[1:] - 1] = 32
    return out, at.astype(np.int32 if at[-1] < 1 << 31 else np.int64)


def _scan(batch: pa.RecordBatch, text: str, windows: BenchmarkWindows) -> Iterator[tuple]:
    """(row, words, hit words, items, spans) of each text; a span is bytes [start, end) and words [first, last)."""
    data, offsets, _ = K.column_bytes(batch.column(text))
    for a, b in K.pieces(offsets):
        bounds = offsets[a : b + 1] - offsets[a]
        low, starts, ends, owner = K.words(data[offsets[a] : offsets[b]], bounds[:-1])
        hit, items = windows.hits(low, starts, ends, owner)
        n_words = np.bincount(owner, minlength=b - a)
        n_hit = np.bincount(owner, weights=hit, minlength=b - a).astype(np.int64)
        spans: dict[int, list] = {}
        for x in np.flatnonzero(hit & np.r_[True, ~hit[:-1] | (owner[1:] != owner[:-1])]).tolist() if hit.any() else ():
            stop = x
            while stop + 1 < len(hit) and hit[stop + 1] and owner[stop + 1] == owner[x]:
                stop += 1
            base, word = bounds[owner[x]], np.searchsorted(owner, owner[x])
            spans.setdefault(int(owner[x]), []).append((int(starts[x] - base), int(ends[stop] - base), int(x - word), int(stop + 1 - word)))
        for i in range(b - a):
            yield a + i, int(n_words[i]), int(n_hit[i]), items.get(i, ()), spans.get(i, [])


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, most_bytes: int | None = None) -> tuple[int, Iterator[tuple[list, list]]]:
    """How many blocks the benchmark makes, and the blocks: ids and texts, of at most about `most_bytes` (one item at least).

    Usual benchmarks make one block.  The size is known before anything is
    collected; items are split over blocks by a hash, and the driver holds one
    block at a time.
    """
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // (most_bytes or BENCHMARK_BYTES) + 1

    def each():
        for k in range(n):
            got = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("text", "item"), F.lit(n)) == k)).collect()
            yield [r.item for r in got], [r.text for r in got]

    return n, each()


_FOUND = "row long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long,first:long,last:long>>"


def _scan_block(rows: DataFrame, shared, all_rows: bool) -> DataFrame:
    """Findings of one block in rows(row, text): of all rows, or of those with a hit."""

    def scan(batches):
        windows = shared.value
        for batch in batches:
            out = [x for x in _scan(batch, "text", windows) if all_rows or x[2]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(pa.array([x[0] for x in out], pa.int64())),
                    pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()),
                    pa.array([sorted(windows.names[i] for i in x[3]) for x in out], pa.list_(pa.string())),
                    pa.array([[dict(zip(_SPAN_FIELDS, s)) for s in x[4]] for x in out], _SPANS),
                ],
                ["row", "n_words", "n_hit", "items", "spans"],
            )

    return rows.mapInArrow(scan, _FOUND)


def _blocks_found(docs: DataFrame, blocks: Iterator[tuple[list, list]], text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """docs with a row number `_row`, a name that docs must not have, and the merged findings of all blocks by `row`.

    docs are written once, so that a number stays with its row.  Each block is
    scanned and its findings written before the next is read, so driver and
    tasks hold one block; only the findings are shuffled.
    """
    spark = docs.sparkSession
    numbered = settle(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = None
    for ids, texts in blocks:
        shared = spark.sparkContext.broadcast(BenchmarkWindows(ids, texts, window))
        part = settle(_scan_block(numbered.select(F.col("_row").alias("row"), F.col(text).alias("text")), shared, False), "hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return numbered, _merge_blocks(found)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, words_per_hit: int = 20) -> DataFrame:
    """Contamination of each document: words, hit words, items, hit spans and verdict.

    One row per row of docs.  A null or empty text has no words and is clean;
    an empty benchmark leaves all clean; null items are ignored, repeated items
    are each named; repeated rows and rows with a null id come back as they came.
    `contaminated`: some word is hit, and at least one of each `words_per_hit`.
    Spans are byte and word ranges of the text.  Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n, blocks = benchmark_blocks(benchmark, item_id, item_text)
    if n == 1:
        shared = docs.sparkSession.sparkContext.broadcast(BenchmarkWindows(*next(blocks), window))
        found = _scan_block(rows.select(F.col("doc_id").alias("row"), "text"), shared, True).withColumnRenamed("row", "doc_id")
    else:
        numbered, hit = _blocks_found(rows, blocks, "text", window)
        # the number of words of the rows without a hit, by an empty block
        words = _scan_block(numbered.select(F.col("_row").alias("row"), "text"), docs.sparkSession.sparkContext.broadcast(BenchmarkWindows([], [], window)), True).select("row", "n_words")
        found = numbered.select(F.col("_row").alias("row"), "doc_id").join(words, "row").join(hit.drop("n_words"), "row", "left")
        found = found.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), *(F.coalesce(c, F.array().cast(hit.schema[c].dataType)).alias(c) for c in ("items", "spans")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (words_per_hit * F.col("n_hit") >= F.col("n_words")))


def _merge_blocks(found: DataFrame) -> DataFrame:
    """One row per document from the findings of several benchmark blocks."""
    by_row = found.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("items"))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    # spans of different blocks may overlap: fold them, in order, into disjoint ones
    joined = F.expr("""aggregate(spans, cast(array() as array<struct<start:long,end:long,first:long,last:long>>), (done, x) ->
        if(size(done) > 0 and element_at(done, -1).last >= x.first,
           concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, x.end), 'first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, x.last)))),
           concat(done, array(x))))""")
    return by_row.withColumn("spans", joined).select("row", "n_words", F.expr("aggregate(spans, 0L, (n, x) -> n + x.last - x.first)").alias("n_hit"), "items", "spans")


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    raw, kept, at = text.encode(), [], 0
    for s, e in spans:
        kept.append(raw[at:s])
        at = e
    return b"".join([*kept, raw[at:]]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """docs with the hit spans cut out of their texts; all columns stay.

    Every span is found in the text as it came, also where the benchmark makes
    several blocks.  Null and empty texts stay as they are.
    """
    n, blocks = benchmark_blocks(benchmark, item_id, item_text)
    place = docs.columns.index(text)
    if n > 1:
        names, schema = docs.columns, docs.schema
        docs, text = set_aside(docs, text)
        numbered, found = _blocks_found(docs, blocks, text, window)

        def cut_found(batches):
            for batch in batches:
                texts, spans = batch.column(place).to_pylist(), batch.column("_spans").to_pylist()
                columns = list(batch.columns[: len(names)])
                columns[place] = pa.array([_cut(t, [(x["start"], x["end"]) for x in s]) if s else t for t, s in zip(texts, spans)], columns[place].type)
                yield pa.RecordBatch.from_arrays(columns, names)

        joined = numbered.join(found.select(F.col("row").alias("_row"), F.col("spans").alias("_spans")), "_row", "left")
        return joined.select(*docs.columns, "_spans").mapInArrow(cut_found, schema)
    shared = docs.sparkSession.sparkContext.broadcast(BenchmarkWindows(*next(blocks), window))

    def cut(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            trial = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
            for row, _, _, _, spans in _scan(trial, "text", shared.value):
                if spans:
                    texts[row] = _cut(texts[row], [x[:2] for x in spans])
            columns = list(batch.columns)
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(cut, docs.schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, words_per_hit: int = 20) -> DataFrame:
    """docs without the contaminated documents; all columns stay.

    With a benchmark of one block nothing is shuffled; with several, the blocks'
    spans of a document are merged before it is judged, as in contamination().
    Null and empty texts are clean and stay, whatever their id.
    """
    n, blocks = benchmark_blocks(benchmark, item_id, item_text)
    if n > 1:
        names = docs.columns
        docs, text = set_aside(docs, text)
        numbered, found = _blocks_found(docs, blocks, text, window)
        gone = found.where(words_per_hit * F.col("n_hit") >= F.col("n_words")).select(F.col("row").alias("_row"))
        return numbered.join(gone, "_row", "left_anti").select(*docs.columns).toDF(*names)
    shared = docs.sparkSession.sparkContext.broadcast(BenchmarkWindows(*next(blocks), window))

    def keep(batches):
        for batch in batches:
            ok = [not (x[2] > 0 and words_per_hit * x[2] >= x[1]) for x in _scan(batch, text, shared.value)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of contamination() over documents and benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

#: Windows as joined words; those of the documents are made for each size that an item has.
OP1_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
item_window AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
size AS (SELECT DISTINCT n FROM item_window),
doc_window AS (
  SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc, size WHERE len(w) >= n)),
hit AS (SELECT d.r, d.n, d.k, i.item FROM doc_window d JOIN item_window i ON d.n = i.n AND d.gram = i.gram),
word_hit AS (SELECT r, count(DISTINCT k + o) AS n_hit FROM (SELECT r, k, unnest(range(0, n)) AS o FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc.doc_id, CAST(len(doc.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(doc.w) AS contaminated
FROM doc LEFT JOIN word_hit USING (r) LEFT JOIN named USING (r)
"""
