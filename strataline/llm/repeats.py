"""Suffix-array dedup (operator 10): maximal repeats over all documents.

A byte string of `least` bytes that stands at two places makes both places
choose the same seed inside it: the smallest hash among its short substrings.
So a suffix array over the seeds alone holds every repeat.

1. Each text yields its seeds.  A seed's region is the union of the windows
   that chose it.  Seeds are range-partitioned and sorted by (seed, region,
   document, position), so that a frequent seed is spread over many tasks.
   Equal regions stand together: all but the first are repeats as a whole.
2. The first ones of regions that share a seed without being equal get their
   bytes and are sorted by the bytes right of the seed: an enhanced suffix
   array.  A stack scan over its common-prefix lengths gives the interval tree.
   In each interval the left contexts are scanned in the same way; a group that
   neither side can extend without losing an occurrence is a maximal repeat,
   and every occurrence in it but the first is covered.
3. Where the order was cut between two tasks, the rows of the seed at the cut
   are sorted once more, by the bytes left of it.  The few windows that reach a
   cut in both orders meet in one aggregation by the hash of their content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.llm import textkit as K
from strataline.llm.shared import set_aside, settle

LEAST_BYTES = 100
SEED_BYTES = 24
SCAN_ROWS = 60_000
SMALL_ROWS = 100_000  # rows of 24 bytes that may be broadcast
_POSITION_BITS = np.uint64(21)
_POSITION_MASK = np.uint64((1 << 21) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    size, least = 1, values
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def seeds_of(data: np.ndarray, bounds: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, seed offset, seed hash, region hash) of all seeds of a piece."""
    width = least - seed + 1
    if len(data) < least:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    sums = K.prefix_sums(K.byte_values(data))
    at = np.arange(len(data) - seed + 1)
    hashes = K.span_hash(sums, at, at + seed)
    chosen = sliding_min((hashes >> _POSITION_BITS << _POSITION_BITS) | at.astype(np.uint64), width) & _POSITION_MASK
    owner = np.searchsorted(bounds, np.arange(len(chosen)), side="right") - 1
    ends = np.r_[bounds[1:], len(data)]
    starts = np.flatnonzero(np.arange(len(chosen)) + least <= ends[owner])
    if not len(starts):
        return seeds_of(data[:0], bounds, least, seed)
    pick, own = chosen[starts].astype(np.int64), owner[starts]
    new = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (own[1:] != own[:-1])])
    first = starts[new]
    count = np.diff(np.r_[new, len(starts)])
    spot = pick[new]
    return own[new], first, count, spot - first, hashes[spot], K.span_hash(sums, first, first + count - 1 + least)


_SEED_SCHEMA = "seed long, region long, doc_id long, start long, shape int"


def _seed_rows(least: int, seed: int):
    step = 1 << 20  # windows of one long text that are taken together

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, base = np.asarray(batch.column("doc_id")), np.asarray(batch.column("base"))
            data, offsets, _ = K.column_bytes(batch.column("text"))
            for a, b in K.pieces(offsets):
                lo, hi = int(offsets[a]), int(offsets[b])
                for cut in range(lo, max(hi, lo + 1), step):
                    if cut > lo and b - a > 1:
                        break
                    stop = hi if b - a > 1 else min(hi, cut + step + least - 1)
                    bounds = offsets[a:b] - lo if b - a > 1 else np.zeros(1, np.int64)
                    own, first, count, off, h, region = seeds_of(data[cut:stop], bounds, least, seed)
                    if len(own):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(h.view(np.int64)), pa.array(region.view(np.int64)), pa.array(ids[a + own]),
                                pa.array(base[a + own] + first - bounds[own] + (cut - lo)), pa.array((off * 128 + count).astype(np.int32)),
                            ],
                            ["seed", "region", "doc_id", "start", "shape"],
                        )

    return make


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _scan_regions(least: int):
    """Covered spans of all but the first of equal regions; firsts whose seed has other regions."""

    def scan(batches):
        for t in _blocks(batches, 4 * SCAN_ROWS):
            seed, region, doc, start = (np.asarray(t.column(c)) for c in ("seed", "region", "doc_id", "start"))
            shape = np.asarray(t.column("shape"))
            new_seed = np.r_[True, seed[1:] != seed[:-1]]
            new_region = new_seed | np.r_[True, region[1:] != region[:-1]]
            group = np.cumsum(new_seed) - 1
            head = np.flatnonzero(new_region)[np.cumsum(new_region) - 1]
            later = (doc != doc[head]) | (start != start[head])
            regions = np.bincount(group, weights=new_region)
            open_ = new_region & ((regions[group] > 1) | (group == 0) | (group == group[-1]))
            take = later | open_
            yield pa.RecordBatch.from_arrays(
                [pa.array(open_[take]), pa.array(seed[take]), pa.array(doc[take]), pa.array(start[take]), pa.array((start + (shape & 127) - 1 + least)[take]), pa.array((start + (shape >> 7))[take])],
                ["open", "seed", "doc_id", "start", "end", "spot"],
            )

    return scan


def _contexts():
    """The bytes left (reversed) and right of each open seed, from the text."""

    def cut(batches):
        for batch in batches:
            raw, offsets, _ = K.column_bytes(batch.column("text"))
            lists = batch.column("open_seeds")
            flat = lists.flatten()
            own = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            seed, start, end, spot = (np.asarray(flat.field(k)) for k in range(4))
            base = offsets[own] - np.asarray(batch.column("base"))[own]  # of the document's first byte
            ids = np.asarray(batch.column("doc_id"))[own]
            fits = (base + start >= offsets[own]) & (base + end <= offsets[own + 1])
            left, right = [], []
            for b, s, e, q in zip(base[fits].tolist(), start[fits].tolist(), end[fits].tolist(), spot[fits].tolist()):
                left.append(raw[b + s : b + q][::-1].tobytes())
                right.append(raw[b + q : b + e].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(seed[fits]), pa.array(right, pa.binary()), pa.array(left, pa.binary()), pa.array(ids[fits]), pa.array(spot[fits])], ["seed", "rest", "before", "doc_id", "spot"])

    return cut


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, and their lengths."""
    column = column.combine_chunks().cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.diff(offs)
    out = np.zeros((len(column), width), np.uint8)
    inside = np.arange(width) < size[:, None]
    out[inside] = flat[offs[0] : offs[-1]]
    return out, size


def _common(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the rows of two matrices."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(a_size, b_size))


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of each interval of the common-prefix tree with depth >= least.

    lcp[i] belongs to rows i and i + 1.  One pass with a stack.
    """
    stack: list[tuple[int, int]] = []  # depth, first row
    for i, depth in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > depth:
            at, first = stack.pop()
            yield first, i, at
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def covered_spans(seed: np.ndarray, right: np.ndarray, right_size: np.ndarray, left: np.ndarray, left_size: np.ndarray, rank: np.ndarray, least: int, seed_bytes: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(rows, left bytes, right bytes) of each maximal repeat of at least `least` bytes.

    The rows are sorted by (seed, right).  The first row given is the earliest
    occurrence by rank.
    """
    if len(seed) < 2:
        return
    lcp = np.where(seed[1:] == seed[:-1], _common(right[1:], right_size[1:], right[:-1], right_size[:-1]), 0)
    near = _common(left[1:], left_size[1:], left[:-1], left_size[:-1])
    for i, j, depth in intervals(lcp, seed_bytes):
        if j == i + 1:
            if near[i] + depth >= least:
                yield (np.array([i, j]) if rank[i] <= rank[j] else np.array([j, i])), int(near[i]), depth
            continue
        rows = np.arange(i, j + 1)
        # the left contexts in order, and the tree of their common parts
        rows = rows[np.lexsort((left_size[rows], *left[rows].T[::-1]))]
        both = _common(left[rows[1:]], left_size[rows[1:]], left[rows[:-1]], left_size[rows[:-1]])
        for a, b, reach in intervals(both, max(0, least - depth)):
            group = rows[a : b + 1]
            yield group[np.argsort(rank[group], kind="stable")], reach, depth


def _hits(seed, right, right_size, left, left_size, rank, least: int, seed_bytes: int, left_width: int) -> np.ndarray:
    """For each row, by the bytes left of the seed, whether that window also starts earlier."""
    hit = np.zeros((len(seed), left_width + 1), dtype=bool)
    for rows, reach, depth in covered_spans(seed, right, right_size, left, left_size, rank, least, seed_bytes):
        later = rows[rank[rows] > rank[rows[0]]]
        hit[later, max(0, least - depth) : reach + 1] = True
    return hit


def _hit_spans(hit: np.ndarray, doc: np.ndarray, spot: np.ndarray, least: int) -> pa.RecordBatch:
    edge = np.zeros((len(hit), hit.shape[1] + 2), dtype=np.int8)
    edge[:, 1:-1] = hit
    step = np.diff(edge, axis=1)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    return pa.RecordBatch.from_arrays([pa.array(doc[row], pa.int64()), pa.array(spot[row] - (high - 1), pa.int64()), pa.array(spot[row] - low + least, pa.int64())], ["doc_id", "start", "end"])


def _edge_reach(seed: np.ndarray, side: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many bytes of `side` each row shares with the first or last row of the block; -1 for other seeds."""
    reach = np.full(len(seed), -1)
    for k in (0, len(seed) - 1):
        rows = np.flatnonzero(seed == seed[k])
        here = np.full(len(rows), k)
        reach[rows] = np.maximum(reach[rows], _common(side[rows], size[rows], side[here], size[here]))
    return reach


def _padded(found: pa.RecordBatch, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    have = set(found.schema.names)
    return pa.RecordBatch.from_arrays([found.column(n) if n in have else pa.nulls(found.num_rows, t) for n, t in zip(names, types)], names)


_FIRST_SCHEMA = "doc_id long, start long, end long, seed long, rest binary, before binary, spot long, reach int"
_FIRST = (["doc_id", "start", "end", "seed", "rest", "before", "spot", "reach"], [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int64(), pa.int32()])
_SECOND_SCHEMA = "doc_id long, start long, end long, h1 long, h2 long"
_SECOND = (["doc_id", "start", "end", "h1", "h2"], [pa.int64()] * 5)


def _block(t: pa.Table, least: int, left_width: int):
    seed, doc, spot = (np.asarray(t.column(c)) for c in ("seed", "doc_id", "spot"))
    _, rank = np.unique(np.rec.fromarrays([doc, spot]), return_inverse=True)
    return seed, doc, spot, rank, *_matrix(t.column("rest"), least), *_matrix(t.column("before"), left_width)


def _scan_right(least: int, seed_bytes: int):
    """Spans found in blocks sorted by the bytes right of the seed.

    A seed at an end of a block may go on in another block.  Its rows are given
    again, with the bytes shared with that end: only windows within them can be
    repeated there.
    """
    left_width = least - seed_bytes
    lefts = np.arange(left_width + 1)

    def scan(batches):
        for t in _blocks(batches, SCAN_ROWS):
            seed, doc, spot, rank, right, right_size, left, left_size = _block(t, least, left_width)
            hit = _hits(seed, right, right_size, left, left_size, rank, least, seed_bytes, left_width)
            yield _padded(_hit_spans(hit, doc, spot, least), *_FIRST)
            reach = _edge_reach(seed, right, right_size)
            rows = np.flatnonzero((~hit & (lefts <= left_size[:, None]) & (lefts >= least - reach[:, None])).any(axis=1))
            again = t.select(["doc_id", "seed", "rest", "before", "spot"]).take(pa.array(rows)).append_column("reach", pa.array(reach[rows], pa.int32()))
            for batch in again.combine_chunks().to_batches():
                yield _padded(batch, *_FIRST)

    return scan


def _scan_left(least: int, seed_bytes: int):
    """The same for those rows in blocks sorted by the bytes left of the seed.

    What is not found here either, and reaches the end of a block on both
    sides, is given with the hash of its window.
    """
    left_width = least - seed_bytes
    lefts = np.arange(left_width + 1)
    weights = [np.array([pow(m, k, 1 << 64) for k in range(least)], dtype=np.uint64) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]

    def scan(batches):
        for t in _blocks(batches, SCAN_ROWS):
            seed, doc, spot, rank, right, right_size, left, left_size = _block(t, least, left_width)
            order = np.lexsort((right_size, *right.T[::-1], seed))
            hit = np.zeros((len(seed), left_width + 1), dtype=bool)
            hit[order] = _hits(seed[order], right[order], right_size[order], left[order], left_size[order], rank[order], least, seed_bytes, left_width)
            yield _padded(_hit_spans(hit, doc, spot, least), *_SECOND)
            right_reach, left_reach = np.asarray(t.column("reach")).astype(np.int64), _edge_reach(seed, left, left_size)
            live = ~hit & (lefts <= np.minimum(left_size, left_reach)[:, None]) & (lefts >= least - np.minimum(right_size, right_reach)[:, None])
            flat = np.concatenate([left[:, ::-1], right], axis=1)
            for k in np.flatnonzero(live.any(axis=0)).tolist():
                rows = np.flatnonzero(live[:, k])
                window = K.byte_values(flat[rows, left_width - k : left_width - k + least])
                h1, h2 = (pa.array(K.mix((window * w).sum(axis=1, dtype=np.uint64)).view(np.int64)) for w in weights)
                yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(spot[rows] - k), pa.array(spot[rows] - k + least), h1, h2], _SECOND[0])

    return scan


def _placed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with `_cut_id` and `_cut_base`: where the text of a row starts in its document.

    A document is all the different texts of one id, one after the other by
    hash; matches stay inside one text.  Nearly every id has one text, so only
    the texts that start behind others are named, and joined by broadcast while
    they are few.
    """
    named = docs.withColumns({"_cut_id": F.col(doc_id).cast("long"), "_cut_h": F.xxhash64(F.col(text))})
    texts = named.where(F.col("_cut_id").isNotNull()).select("_cut_id", "_cut_h", F.octet_length(F.col(text)).cast("long").alias("_cut_n")).where("_cut_n > 0").distinct()
    before = Window.partitionBy("_cut_id").orderBy("_cut_h").rowsBetween(Window.unboundedPreceding, -1)
    behind = settle(texts.withColumn("_cut_base", F.sum("_cut_n").over(before)).where("_cut_base > 0").drop("_cut_n"), "texts")
    side = F.broadcast(behind) if behind.count() <= SMALL_ROWS else behind.hint("merge")
    return named.join(side, ["_cut_id", "_cut_h"], "left").drop("_cut_h").withColumn("_cut_base", F.coalesce("_cut_base", F.lit(0).cast("long")))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_BYTES, seed_bytes: int = SEED_BYTES) -> DataFrame:
    """(doc_id, start, end): byte spans covered by strings of `least` bytes that also start earlier.

    Earlier means a smaller doc_id, or the same document and an earlier start.
    The spans of a document may overlap.  Texts that are null, empty or shorter
    than `least` bytes, and rows with a null id, give none.  Rows that repeat an
    id and its text are one document; if an id has several texts, its offsets
    run on through them in the order of their hashes (xxhash64).  Other columns
    are not read.
    """
    return _spans(_placed(docs.select(doc_id, text), doc_id, text), text, least, seed_bytes)


def _spans(placed: DataFrame, text: str, least: int, seed_bytes: int) -> DataFrame:
    rows = placed.select(F.col("_cut_id").alias("doc_id"), F.col(text).alias("text"), F.col("_cut_base").alias("base")).where("doc_id is not null and octet_length(text) >= " + str(least))
    seeds = rows.mapInArrow(_seed_rows(least, seed_bytes), _SEED_SCHEMA)
    order = ["seed", "region", "doc_id", "start"]
    regions = settle(
        seeds.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan_regions(least), "open boolean, seed long, doc_id long, start long, end long, spot long"),
        "regions",
    )
    by_doc = regions.where("open").groupBy("doc_id").agg(F.collect_set(F.struct("seed", "start", "end", "spot")).alias("open_seeds"))
    contexts = rows.join(by_doc, "doc_id").mapInArrow(_contexts(), "seed long, rest binary, before binary, doc_id long, spot long")
    order = ["seed", "rest", "doc_id", "spot"]
    first = settle(contexts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan_right(least, seed_bytes), _FIRST_SCHEMA), "intervals")
    order = ["seed", "before", "doc_id", "spot"]
    again = first.where("seed is not null").select("seed", "rest", "before", "doc_id", "spot", "reach")
    second = settle(again.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan_left(least, seed_bytes), _SECOND_SCHEMA), "ends")
    windows = second.where("h1 is not null")
    firsts = settle(windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max(F.struct("doc_id", "start")).alias("last")).where("first < last").drop("last"), "windows")
    across = windows.join(firsts, ["h1", "h2"]).where(F.struct("doc_id", "start") != F.col("first"))
    parts = [regions.where("not open"), first.where("seed is null"), second.where("h1 is null"), across]
    spans = [x.select("doc_id", "start", "end") for x in parts]
    return spans[0].unionByName(spans[1]).unionByName(spans[2]).unionByName(spans[3])


def merge_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, starts, ends): the disjoint covered runs of each document, in order."""
    grouped = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def merge(batches):
        for batch in batches:
            lists = batch.column("spans")
            flat = lists.flatten()
            own = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            start, end = np.asarray(flat.field(0)), np.asarray(flat.field(1))
            order = np.lexsort((start, own))
            own, start, end = own[order], start[order], end[order]
            lift = own * (int(end.max(initial=0)) + 1)
            reach = np.maximum.accumulate(end + lift) if len(end) else end
            new = np.r_[True, (own[1:] != own[:-1]) | (start[1:] + lift[1:] > reach[:-1])] if len(own) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            stops = (reach - lift)[np.r_[at[1:] - 1, len(own) - 1]] if len(at) else at
            sizes = np.bincount(own[at], minlength=batch.num_rows)
            offs = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offs, pa.array(start[at])), pa.ListArray.from_arrays(offs, pa.array(stops))], ["doc_id", "starts", "ends"])

    return grouped.mapInArrow(merge, "doc_id long, starts array<long>, ends array<long>")


def _kept(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    keep = np.ones(len(raw), dtype=bool)
    for s, e in zip(starts.tolist(), ends.tolist()):
        keep[s:e] = False
    return raw[keep].tobytes()


def _own_runs(batch: pa.RecordBatch, row: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the document that lie in the text of a row, from the start of the text."""
    base = batch.column("_cut_base")[row].as_py()
    starts, ends = (np.asarray(batch.column(c)[row].values if batch.column(c)[row].is_valid else [], np.int64) - base for c in ("_cut_starts", "_cut_ends"))
    starts, ends = np.maximum(starts, 0), np.minimum(ends, size)
    return starts[starts < ends], ends[starts < ends]


def _with_runs(docs: DataFrame, doc_id: str, text: str, least: int, seed_bytes: int) -> DataFrame:
    """docs with `_cut_id`, `_cut_base` and the covered runs `_cut_starts` and `_cut_ends` of the row's document."""
    placed = _placed(docs, doc_id, text)
    runs = merge_spans(_spans(placed, text, least, seed_bytes))
    return placed.join(runs.select(F.col("doc_id").alias("_cut_id"), F.col("starts").alias("_cut_starts"), F.col("ends").alias("_cut_ends")), "_cut_id", "left")


def removal_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_BYTES, seed_bytes: int = SEED_BYTES) -> DataFrame:
    """Per row of docs: n_bytes, removed bytes and runs, and SHA-256 of the bytes that stay.

    A null text has no bytes.  Rows with a null id lose nothing.  Rows that
    repeat an id and its text fare alike; of several texts of an id each loses
    what also starts in one before it (in the order of hashes).
    """
    rows = _with_runs(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", least, seed_bytes)

    def digest(batches):
        for batch in batches:
            data, offsets, _ = K.column_bytes(batch.column("text"))
            removed, count, sums = [], [], []
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]]
                starts, ends = _own_runs(batch, i, len(raw))
                kept = _kept(raw, starts, ends) if len(starts) else raw.tobytes()
                removed.append(len(raw) - len(kept))
                count.append(len(starts))
                sums.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_cut_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sums, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.select("_cut_id", "text", "_cut_base", "_cut_starts", "_cut_ends").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_BYTES, seed_bytes: int = SEED_BYTES) -> DataFrame:
    """docs with the repeated spans cut out of their texts; other columns stay.

    Only whole characters go, so the texts stay valid.  Rows of which nothing
    is left are dropped; texts that were null or empty stay.  Several texts of
    one id are parts of one document, as in repeated_spans.
    """
    names, schema, place = docs.columns, docs.schema, docs.columns.index(text)
    docs, doc_id, text = set_aside(docs, doc_id, text)
    rows = _with_runs(docs, doc_id, text, least, seed_bytes).select(*docs.columns, "_cut_base", "_cut_starts", "_cut_ends")

    def cut(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            stay = np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(np.asarray(batch.column("_cut_starts").is_valid())).tolist():
                raw = np.frombuffer((texts[i] or "").encode(), np.uint8)
                starts, ends = _own_runs(batch, i, len(raw))
                if not len(starts):
                    continue
                # the next start of a character from each start, the last one before each end
                whole = np.flatnonzero(np.r_[(raw & 0xC0) != 0x80, True])
                starts, ends = whole[np.searchsorted(whole, starts)], whole[np.searchsorted(whole, ends, side="right") - 1]
                texts[i] = _kept(raw, starts, ends).decode()
                stay[i] = bool(texts[i])
            columns = [batch.column(k) for k in range(len(names))]
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stay))

    return rows.mapInArrow(cut, schema)


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: 100-byte repeats over the whole of documents."""
    return removal_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
