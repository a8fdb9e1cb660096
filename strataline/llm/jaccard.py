"""N-gram Jaccard join (operator 9) with Bayesian candidate pruning.

Documents with the same word sequence form one class, so copies are never
paired.  MinHash bands propose pairs of classes.  A pair's MinHash values are
compared a few at a time; it is dropped as soon as the posterior probability
that its similarity reaches the threshold falls below the tolerance.  The
others are verified on their exact shingle sets.

A band bucket of any size is split into blocks, and each pair of blocks is one
unit of work, so a large group never lands in one task.  Units give link counts
and spanning links, not pairs.  A pair that shares several bands is counted in
the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import textkit as K
from strataline.llm.shared import components, set_aside, settle, table

SHINGLE_WORDS = 5
THRESHOLD = 0.8
HASHES = 128
BAND_ROWS = 4
STEP = 16
TOLERANCE = 1e-6
BLOCK = 512  # classes of a block, and their shingles
BLOCK_GRAMS = 1 << 20
UNIT_BYTES = 8 << 20

_rng = np.random.RandomState(971)
_MULTIPLY = _rng.randint(1, 1 << 62, HASHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.randint(1, 1 << 62, HASHES).astype(np.uint64)


def shingles(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes and owners; word hashes and owners.  A text of fewer words, but not none, is one shingle."""
    low, starts, ends, owner = K.words(data, bounds)
    h = K.word_hashes(low, starts, ends)
    first, grams = K.window_hashes(h, owner, size)
    own = owner[first]
    count = np.bincount(owner, minlength=len(bounds))
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        at = np.searchsorted(owner, short)
        grams = np.r_[grams, K.span_hash(K.prefix_sums(h), at, at + count[short])]
        own = np.r_[own, short]
        order = np.argsort(own, kind="stable")
        grams, own = grams[order], own[order]
    return grams, own, h, owner


def _signatures(size: int):
    def sign(batches):
        for batch in batches:
            data, offsets, _ = K.column_bytes(batch.column("text"))
            for a, b in K.pieces(offsets):
                grams, own, h, owner = shingles(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], size)
                if not len(own):
                    continue
                at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                rows = own[at]
                sig = np.empty((len(at), HASHES), np.uint32)
                for k in range(HASHES):
                    sig[:, k] = np.minimum.reduceat(((grams * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), at)
                first = np.searchsorted(owner, rows)
                last = np.searchsorted(owner, rows, side="right")
                names = [K.span_hash(K.prefix_sums(v), first, last).view(np.int64) for v in (h, K.mix(h + np.uint64(77)))]
                size_of = np.diff(np.r_[at, len(own)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(a + rows)) for c in ("doc_id", "h")), pa.array(names[0]), pa.array(names[1]), pa.array(size_of), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "h", "s1", "s2", "n_grams", "sig"])

    return sign


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = sig.reshape(len(sig), HASHES // BAND_ROWS, BAND_ROWS).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(parts.shape[1], dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def _band_rows(batches):
    for batch in batches:
        grams = np.asarray(batch.column("n_grams"))
        sig = _sig_matrix(batch.column("sig"))
        keys = band_keys(sig)
        n = keys.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(batch.column("node")), n)), pa.array(np.repeat(grams, n)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(sig)))],
            ["bucket", "node", "n_grams", "band"],
        )


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each number n of compared values, the matches below which a pair is dropped.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1),
    so P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = [0]
    for n in range(1, HASHES + 1):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _units(batches: Iterator[pa.RecordBatch], most_bytes: int = UNIT_BYTES) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units of the sorted rows, of about `most_bytes` or one unit, and the first row of each unit."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for k in range(0, batch.num_rows, 1_000):
            held.append(batch.slice(k, 1_000))
            size += held[-1].nbytes
            if size >= most_bytes:
                t = pa.Table.from_batches(held)
                cut = _unit_starts(t)
                if cut[-1]:
                    yield t.slice(0, cut[-1]).combine_chunks(), cut[:-1]
                    held = t.slice(cut[-1]).to_batches()
                    size = sum(x.nbytes for x in held)
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        if t.num_rows:
            yield t, _unit_starts(t)


def _unit_starts(t: pa.Table) -> np.ndarray:
    bucket, i, j = (np.asarray(t.column(c)) for c in ("bucket", "i", "j"))
    return np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])


def _unit_pairs(starts: np.ndarray, ends: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of all units, a bounded number at a time."""
    size, inner = ends - starts, (i == j)[starts]
    for m in np.unique(size[inner & (size > 1)]).tolist():
        a, b = np.triu_indices(m, 1)
        all_ = starts[inner & (size == m)]
        step = max(1, 40_000 // len(a))
        for k in range(0, len(all_), step):
            base = all_[k : k + step, None]
            yield (base + a).ravel(), (base + b).ravel()
    for s, e in zip(starts[~inner].tolist(), ends[~inner].tolist()):
        left, right = s + np.flatnonzero(own[s:e] == i[s]), s + np.flatnonzero(own[s:e] == j[s])
        step = max(1, 40_000 // max(1, len(right)))
        for k in range(0, len(left), step):
            part = left[k : k + step]
            yield np.repeat(part, len(right)), np.tile(right, len(part))


def _candidates(threshold: float, tolerance: float):
    need = least_matches(threshold, tolerance)

    def prune(batches):
        for t, starts in _units(batches):
            ends = np.r_[starts[1:], t.num_rows]
            bucket, node, band, own, i, j = (np.asarray(t.column(c)) for c in ("bucket", "node", "band", "own", "i", "j"))
            sig = _sig_matrix(t.column("sig"))
            keys = band_keys(sig)
            got_a, got_b = [], []
            for a, b in _unit_pairs(starts, ends, own, i, j):
                first = (keys[a] == keys[b]).argmax(axis=1) == band[a]
                a, b = a[first], b[first]
                matches = np.zeros(len(a), np.int32)
                for k in range(0, HASHES, STEP):
                    matches += (sig[a, k : k + STEP] == sig[b, k : k + STEP]).sum(axis=1, dtype=np.int32)
                    live = matches >= need[k + STEP]
                    if not live.all():
                        a, b, matches = a[live], b[live], matches[live]
                got_a.append(a)
                got_b.append(b)
            if not got_a:
                continue
            a, b = np.concatenate(got_a), np.concatenate(got_b)
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            rows = np.union1d(a, b)
            counts = np.searchsorted(a, rows, side="right") - np.searchsorted(a, rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[rows]), pa.array(i[rows]), pa.array(j[rows]), pa.array(node[rows]), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(node[b]))],
                ["bucket", "i", "j", "node", "partners"],
            )

    return prune


def _sets(size: int):
    def make(batches):
        for batch in batches:
            data, offsets, _ = K.column_bytes(batch.column("text"))
            ids = np.asarray(batch.column("node"))
            for a, b in K.pieces(offsets):
                grams, own, _, _ = shingles(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], size)
                order = np.lexsort((grams, own))
                grams, own = grams[order], own[order]
                new = np.r_[True, (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])] if len(own) else np.zeros(0, bool)
                grams, own = grams[new], own[new]
                at = np.searchsorted(own, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array([grams[at[k] : at[k + 1]].tobytes() for k in range(b - a)], pa.binary())], ["node", "grams"])

    return make


def _verify(threshold: float):
    def similar(shared, union):
        return shared >= threshold * union - 1e-9

    def check(batches):
        for t, starts in _units(batches):
            ends = np.r_[starts[1:], t.num_rows]
            ids, copies = np.asarray(t.column("node")), np.asarray(t.column("n_copies"))
            sets = [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()]
            size = np.array([len(x) for x in sets], np.int64)
            lists = t.column("partners").combine_chunks()
            flat, offs = np.asarray(lists.flatten()), np.asarray(lists.offsets)
            links, root = np.zeros(t.num_rows, np.int64), ids.copy()
            for s, e in zip(starts.tolist(), ends.tolist()):
                order = np.argsort(ids[s:e])
                a = np.repeat(np.arange(e - s), np.diff(offs[s : e + 1]))
                b = order[np.searchsorted(ids[s:e], flat[offs[s] : offs[e]], sorter=order)]
                if e - s > 8:
                    shared = _shared_counts(sets[s:e], a, b)
                else:
                    shared = np.array([len(np.intersect1d(sets[s + x], sets[s + y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
                ok = similar(shared, size[s + a] + size[s + b] - shared)
                a, b = a[ok], b[ok]
                np.add.at(links, s + a, copies[s + b])
                np.add.at(links, s + b, copies[s + a])
                own = root[s:e]
                while len(a):
                    low = np.minimum(own[a], own[b])
                    if (own[a] == low).all() and (own[b] == low).all():
                        break
                    np.minimum.at(own, a, low)
                    np.minimum.at(own, b, low)
            linked = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(links[linked]), pa.array(root[linked])], ["node", "links", "root"])

    return check


def _shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (a, b), by products of slices of an incidence matrix."""
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(256, 8_000_000 // len(sets))
    for lo in range(0, len(values), width):
        x, y = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(sets), min(width, len(values) - lo)), np.float32)
        part[row[x:y], column[x:y] - lo] = 1
        total += part @ part.T
    return np.rint(total[a, b]).astype(np.int64)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))


def _linked(rows: DataFrame, size: int, threshold: float, tolerance: float) -> DataFrame:
    """(doc_id, h, class_id, n_links, first) of the rows with an id and words; first: the least (doc_id, h) of the group.

    Classes go by a number of their own, since an id may have several texts.
    """
    signed = settle(rows.where("doc_id is not null").mapInArrow(_signatures(size), "doc_id long, h long, s1 long, s2 long, n_grams long, sig binary"), "signatures")
    least = signed.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count("*").alias("n_copies"), F.first("n_grams").alias("n_grams"), F.first("sig").alias("sig"))
    classes = settle(least.withColumn("node", F.monotonically_increasing_id()), "classes")
    bands = classes.select("node", "n_grams", "sig").mapInArrow(_band_rows, "bucket long, node long, n_grams long, band int")
    full = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least("n", F.ceil(F.col("grams") / BLOCK_GRAMS))).cast("int")
    members = bands.join(full, "bucket").select("bucket", "band", "node", blocks.alias("blocks"))
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    units = members.join(classes.select("node", "sig"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "node", "sig")
    key = ["bucket", "i", "j"]
    pairs = settle(
        units.repartition(*key).sortWithinPartitions(*key).mapInArrow(_candidates(threshold, tolerance), "bucket long, i int, j int, node long, partners array<long>"),
        "candidates",
    )
    wanted = pairs.select("node").distinct().join(classes.select("node", "first.*"), "node")
    texts = rows.join(wanted.hint("merge"), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    sets = texts.select("node", "text").mapInArrow(_sets(size), "node long, grams binary")
    ready = pairs.join(classes.select("node", "n_copies"), "node").join(sets, "node")
    verified = settle(
        ready.select(*key, "node", "partners", "n_copies", "grams").repartition(*key).sortWithinPartitions(*key).mapInArrow(_verify(threshold), "node long, links long, root long"),
        "verified", spent=(pairs,),
    )
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    heads = joined.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("head"))
    named = classes.select("s1", "s2", "node", "first", "n_copies").join(links, "node", "left").join(joined.join(heads, "component").select("node", "head"), "node", "left")
    named = named.select("s1", "s2", F.col("first.doc_id").alias("class_id"), (F.col("n_copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("head", "first").alias("first"))
    named = settle(named, "named", spent=(verified, classes))
    return signed.select("doc_id", "h", "s1", "s2").join(named, ["s1", "s2"]).select("doc_id", "h", "class_id", "n_links", "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links, component_id, kept), one row per row of docs.

    class_id: least doc_id among the documents with the same words in the same
    order.  n_links: other rows whose shingle sets reach the threshold, copies
    included.  component_id: least doc_id reachable by links.  kept: doc_id =
    component_id.

    Words are lower-cased runs of letters and digits.  A text of fewer words
    than a shingle is one shingle; a text without words, or a null one, links
    with nothing and is kept.  Every row is a document of its own: rows repeated
    under one id with equal words are copies of each other, with other words
    they have links and a group of their own.  A row with a null id links with
    nothing: its class and component are null and it is kept.  Other columns are
    not read.
    """
    rows = _rows(docs, doc_id, text)
    found = _linked(rows, size, threshold, tolerance).select("doc_id", "class_id", "n_links", F.col("first.doc_id").alias("component_id"))
    # rows without words take part in nothing
    rest = rows.where("doc_id is null").unionByName(rows.where(~_has_word(F.col("text")) & F.col("doc_id").isNotNull()))
    rest = rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _has_word(text):
    return F.coalesce(text, F.lit("")).rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]")


def keep_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near duplicates: the one with the least id.

    If that id has several texts in the group, the one with the least hash
    stays.  Rows that repeat an id and its text leave one row, the least by
    their other columns.  An id keeps those of its texts that are in different
    groups.  Rows with a null id, and texts without words, stay.
    """
    names = docs.columns
    docs, doc_id, text = set_aside(docs, doc_id, text)
    here = docs.withColumns({"_id": F.col(doc_id).cast("long"), "_h": F.xxhash64(F.col(text)), "_n": F.when(F.col(doc_id).isNull(), F.monotonically_increasing_id())})
    gone = _linked(_rows(docs, doc_id, text), SHINGLE_WORDS, THRESHOLD, TOLERANCE).where("first <> struct(doc_id, h)").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    left = here.join(gone.hint("merge"), ["_id", "_h"], "left_anti")
    order = [x.name for x in docs.schema if x.name != text and not any(k in x.dataType.simpleString() for k in ("map<", "variant"))]
    one = left.groupBy("_id", "_h", "_n").agg(F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("row"))
    return one.select("row.*").toDF(*names)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, link counts and groups of all documents: five words, similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"))
