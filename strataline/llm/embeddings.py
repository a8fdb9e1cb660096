"""Embedding near-dedup (operator 7): an epsilon grid order join.

Vectors are scaled to length one, so cosine >= c is distance <= eps.  They are
put in the order of their cells in a grid of width eps over the leading
principal dimensions, within each label.  The sequence is cut into blocks.
Runs of blocks are joined recursively: a pair of runs is split into pairs of
shorter runs only while the boxes around their vectors are at most eps apart.
Pairs of blocks are joined in the same way inside a task, down to short
intervals, whose cosines are computed exactly in double precision.

Equal vectors form one class and are never paired.  Pairs of blocks give link
counts and spanning links, never all pairs, so large groups stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import textkit as K
from strataline.llm.shared import components, settle, table

COSINE = 0.93
BLOCK_ROWS = 512
LEAF_ROWS = 64
FAN_OUT = 16
GRID_DIMS = 4
BOX_DIMS = 12
SUM_ROWS = 64
_SLACK = 1e-6  # boxes are kept in single precision


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _read_vectors(batches):
    """(vec_id, label, name1, name2, bytes) of the usable vectors; names are hashes of label and content."""
    for batch in batches:
        ids, labels, rows = [], [], []
        for vec_id, label, vector in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("vector").to_pylist()):
            if vec_id is None or label is None or not vector or any(x is None for x in vector):
                continue
            v = np.array(vector, np.float64)
            if np.isfinite(v).all() and v.any():
                ids.append(vec_id)
                labels.append(label)
                rows.append(v.tobytes())
        raw = np.frombuffer(b"".join(rows), np.uint8)
        ends = np.cumsum([0, *map(len, rows)])
        names = []
        for twist in (0, 91):
            sums = K.prefix_sums(K.byte_values(raw) + np.uint64(twist))
            names.append(K.mix(K.span_hash(sums, ends[:-1], ends[1:]) ^ np.array(labels, np.int64).astype(np.uint64)).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(names[0]), pa.array(names[1]), pa.array(rows, pa.binary())], ["vec_id", "label", "n1", "n2", "vector"])


def _unit(v: np.ndarray) -> np.ndarray:
    # scaled first, so that neither huge nor tiny components lose the length
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _moments(batches):
    total = None
    for batch in batches:
        for size, rows in _by_size(batch):
            u = _unit(_matrix(batch.column("vector").take(pa.array(rows))))
            part = np.concatenate([u.T @ u, u.sum(axis=0)[None], np.full((1, size), len(u))])
            total = total or {}
            total[size] = total.get(size, 0) + part
    for size, part in (total or {}).items():
        for at in range(0, len(part), SUM_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([at], pa.int32()), pa.array([part[at : at + SUM_ROWS].tobytes()], pa.binary())], ["size", "at", "part"])


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(x) // 8 for x in batch.column("vector").to_pylist()])
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


def _add_up(batches):
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for *key, part in zip(*(batch.column(c).to_pylist() for c in ("size", "at", "part"))):
            total[tuple(key)] = total.get(tuple(key), 0) + np.frombuffer(part, np.float64)
    for (size, at), part in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([at], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["size", "at", "part"])


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector size, the axes of greatest variance, from sums over all vectors.

    The tasks' sums are added up by rows of the matrix, so that one matrix of a
    size reaches the driver, as bytes.
    """
    schema = "size int, at int, part binary"
    parts = classes.select("vector").mapInArrow(_moments, schema).repartition("size", "at").mapInArrow(_add_up, schema).collect()
    axes = {}
    for size in sorted({r["size"] for r in parts}):
        s = np.concatenate([np.frombuffer(r.part, np.float64) for r in sorted(parts, key=lambda r: r.at) if r["size"] == size]).reshape(size + 2, size)
        n = s[-1, 0]
        mean = s[size] / n
        axes[size] = _leading_axes(s[:size] / n - np.outer(mean, mean))
    return axes


def _leading_axes(covariance: np.ndarray) -> np.ndarray:
    """The first BOX_DIMS principal axes; of large matrices by subspace iteration, as any orthonormal axes give right results."""
    size = len(covariance)
    if size <= 1024:
        return np.linalg.eigh(covariance)[1][:, ::-1][:, :BOX_DIMS]
    axes = np.random.RandomState(size).randn(size, 2 * BOX_DIMS)
    for _ in range(12):
        axes = np.linalg.qr(covariance @ axes)[0]
    _, turn = np.linalg.eigh(axes.T @ covariance @ axes)
    return (axes @ turn)[:, ::-1][:, :BOX_DIMS]


def _cells(shared, eps: float):
    def run(batches):
        for batch in batches:
            for size, rows in _by_size(batch):
                part = batch.take(pa.array(rows))
                at = _unit(_matrix(part.column("vector"))) @ shared.value[size]
                cell = np.floor(at[:, :GRID_DIMS] / eps).astype(np.int32)
                cell = np.pad(cell, ((0, 0), (0, GRID_DIMS - cell.shape[1])))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(rows), size, np.int32)), *(pa.array(cell[:, k]) for k in range(GRID_DIMS)), pa.array(at[:, 0])], [*part.schema.names, "size", *(f"cell{k}" for k in range(GRID_DIMS)), "along"])

    return run


def _box(at: np.ndarray) -> np.ndarray:
    """Least and greatest value in each of BOX_DIMS dimensions."""
    box = np.zeros((2, BOX_DIMS), np.float32)
    box[:, : at.shape[1]] = at.min(axis=0), at.max(axis=0)
    return box.ravel()


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance between boxes, along the last axis."""
    d = a.shape[-1] // 2
    gap = np.maximum(0, np.maximum(a[..., :d] - b[..., d:], b[..., :d] - a[..., d:]))
    return np.sqrt((gap * gap).sum(axis=-1))


def _cut_blocks(shared):
    """One row for each block of the sorted sequence: its label, box, ids, copies and vectors."""

    def run(batches):
        from pyspark import TaskContext

        task, count, held = TaskContext.get().partitionId(), 0, None

        def give(t):
            nonlocal count
            label, size = t.column("label")[0].as_py(), t.column("size")[0].as_py()
            v = _matrix(t.column("vector").combine_chunks())
            u = _unit(v)
            count += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([task * (1 << 32) + count]), pa.array([label]), pa.array([size], pa.int32()), pa.array([_box(u @ shared.value[size]).tolist()], pa.list_(pa.float32())),
                    pa.array([np.asarray(t.column("node")).tobytes()], pa.binary()), pa.array([np.asarray(t.column("copies")).tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()),
                ],
                ["block", "label", "size", "box", "ids", "copies", "vectors"],
            )

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows:
                label, size = np.asarray(held.column("label")), np.asarray(held.column("size"))
                run_ = int(np.argmax(np.r_[(label[1:] != label[:-1]) | (size[1:] != size[:-1]), True])) + 1
                if run_ == held.num_rows and run_ < BLOCK_ROWS:
                    break
                take = min(run_, BLOCK_ROWS)
                yield give(held.slice(0, take))
                held = held.slice(take)
        if held is not None and held.num_rows:
            yield give(held)

    return run


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks numbered without gaps in the order of the sequence; the driver sees one count for each task."""
    task = F.shiftright("block", 32)
    counts = sorted((r.task, r.n) for r in blocks.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())
    bases = np.cumsum([0, *(n for _, n in counts)]).tolist()
    known = blocks.sparkSession.createDataFrame([(t, b - 1) for (t, _), b in zip(counts, bases)], "task long, base long")
    return blocks.withColumn("task", task).join(F.broadcast(known), "task").withColumn("block", F.col("base") + F.col("block").bitwiseAND((1 << 32) - 1)).drop("task", "base")


def _level(nodes: DataFrame) -> DataFrame:
    """Runs of FAN_OUT following nodes, with the boxes around them."""
    mins, maxs = (F.array(*[f(F.col("box")[k]) for k in range(lo, lo + BOX_DIMS)]) for f, lo in ((F.min, 0), (F.max, BOX_DIMS)))
    return nodes.groupBy("label", "size", F.col("up").alias("node")).agg(F.concat(mins, maxs).alias("box"))


def _near(a: str, b: str, eps: float) -> str:
    gap = f"greatest(0f, greatest({a}[k] - {b}[k + {BOX_DIMS}], {b}[k] - {a}[k + {BOX_DIMS}]))"
    return f"aggregate(sequence(0, {BOX_DIMS - 1}), 0D, (s, k) -> s + {gap} * {gap}) <= {eps * eps!r}"


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b) with a <= b: the pairs of blocks of one label that may hold linked vectors.

    The runs of blocks form a tree.  The join starts with pairs of its top runs
    and goes down one level at a time, leaving out distant pairs.
    """
    nodes = blocks.select("label", "size", F.col("block").alias("node"), "box")
    # numbers have no gaps, so each level has one FAN_OUT-th of the nodes of the one below
    levels = [settle(nodes.withColumn("up", F.floor(F.col("node") / FAN_OUT)), "level")]
    while len(levels) < 12 and (levels[-1].groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0) > FAN_OUT:
        levels.append(settle(_level(levels[-1]).withColumn("up", F.floor(F.col("node") / FAN_OUT)), "level"))
    top = levels[-1]
    one, two = (top.select("label", "size", F.col("node").alias(x), F.col("box").alias(f"box_{x}")) for x in "ab")
    pairs = one.join(two, ["label", "size"]).where("a <= b").where(_near("box_a", "box_b", eps)).select("label", "size", "a", "b")
    for below in reversed(levels[:-1]):
        one, two = (below.select("label", "size", F.col("up").alias(x), F.col("node").alias(f"n{x}"), F.col("box").alias(f"box_{x}")) for x in "ab")
        pairs = pairs.join(one, ["label", "size", "a"]).join(two, ["label", "size", "b"]).where("na <= nb").where(_near("box_a", "box_b", eps))
        pairs = settle(pairs.select("label", "size", F.col("na").alias("a"), F.col("nb").alias("b")), "pairs")
    return pairs.select("a", "b")


def _join_intervals(u, at, v, bt, same: bool, eps: float) -> Iterator[tuple[slice, slice, bool]]:
    """Pairs of short intervals of two blocks whose boxes are within eps."""
    stack = [(0, len(u), 0, len(v))]
    while stack:
        a, b, c, d = stack.pop()
        if same and c < a or _apart(_box(at[a:b]), _box(bt[c:d])) > eps:
            continue
        if b - a <= LEAF_ROWS and d - c <= LEAF_ROWS:
            yield slice(a, b), slice(c, d), same and a == c
            continue
        rows = [(a, b)] if b - a <= LEAF_ROWS else [(a, a + _half(b - a)), (a + _half(b - a), b)]
        cols = [(c, d)] if d - c <= LEAF_ROWS else [(c, c + _half(d - c)), (c + _half(d - c), d)]
        stack += [(*r, *k) for r in rows for k in cols]


def _half(n: int) -> int:
    return LEAF_ROWS * max(1, (n // 2) // LEAF_ROWS)


def _join_blocks(shared, cosine: float, eps: float):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c: batch.column(c)[k].as_py()  # noqa: E731, B023
                same, size = get("a") == get("b"), get("size")
                ids, copies, units = [], [], []
                for x in ("a", "b"):
                    ids.append(np.frombuffer(get(f"ids_{x}"), np.int64))
                    copies.append(np.frombuffer(get(f"copies_{x}"), np.int64))
                    units.append(_unit(np.frombuffer(get(f"vectors_{x}"), np.float64).reshape(-1, size)))
                at = [w @ shared.value[size] for w in units]
                links = [np.zeros(len(x), np.int64) for x in ids]
                found_a, found_b = [], []
                for r, c, diagonal in _join_intervals(units[0], at[0], units[1], at[1], same, eps):
                    near = units[0][r] @ units[1][c].T >= cosine
                    if diagonal:
                        near = np.triu(near, 1)
                    i, j = np.nonzero(near)
                    if len(i):
                        i, j = i + r.start, j + c.start
                        np.add.at(links[0], i, copies[1][j])
                        np.add.at(links[0 if same else 1], j, copies[0][i])
                        found_a.append(i)
                        found_b.append(j)
                if not found_a:
                    continue
                i, j = np.concatenate(found_a), np.concatenate(found_b)
                n = len(ids[0])
                names = ids[0] if same else np.concatenate(ids)
                root = names.copy()
                j = j if same else j + n
                while True:
                    low = np.minimum(root[i], root[j])
                    if (root[i] == low).all() and (root[j] == low).all():
                        break
                    np.minimum.at(root, i, low)
                    np.minimum.at(root, j, low)
                count = links[0] if same else np.concatenate(links)
                rows = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(names[rows]), pa.array(count[rows]), pa.array(root[rows])], ["node", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors.

    Vectors link if their labels are equal and not null and their cosine, in
    double precision, is `cosine` or more.  A vector that is null, empty, zero
    or has a null or non-finite component links with nothing; so does one with a
    null label or id.  Vectors of different sizes do not link.  Every row is a
    vector of its own: rows repeated under one id link with each other if their
    vectors do, and count as others.  component_id: least vec_id reachable by
    links; kept: vec_id = component_id, and true for a null id.
    """
    eps = float(np.sqrt(2 - 2 * cosine)) + _SLACK
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("vector"))
    named = settle(rows.mapInArrow(_read_vectors, "vec_id long, label long, n1 long, n2 long, vector binary"), "vectors")
    least = named.groupBy("label", "n1", "n2").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = settle(least.withColumn("node", F.monotonically_increasing_id()), "classes")  # an id may have several vectors
    shared = spark.sparkContext.broadcast(principal_axes(classes))
    cells = [f"cell{k}" for k in range(GRID_DIMS)]
    order = ["label", "size", *cells, "along", "node"]
    schema = "node long, label long, copies long, vector binary, size int, " + ", ".join(f"{c} int" for c in cells) + ", along double"
    placed = classes.select("node", "label", "copies", "vector").mapInArrow(_cells(shared, eps), schema)
    blocks = settle(
        placed.repartitionByRange(*order).sortWithinPartitions(*order).select("node", "label", "size", "copies", "vector")
        .mapInArrow(_cut_blocks(shared), "block long, label long, size int, box array<float>, ids binary, copies binary, vectors binary"),
        "blocks",
    )
    numbered = _numbered(blocks)
    one, two = (numbered.select(F.col("block").alias(x), *([F.col("size")] if x == "a" else []), *(F.col(c).alias(f"{c}_{x}") for c in ("ids", "copies", "vectors"))) for x in "ab")
    work = block_pairs(numbered, eps).join(one, "a").join(two, "b")
    found = settle(work.mapInArrow(_join_blocks(shared, cosine, eps), "node long, links long, root long"), "vector-links", spent=(blocks,))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    heads = joined.join(classes.select("node", "class_id"), "node").groupBy("component").agg(F.min("class_id").alias("head"))
    result = classes.select("label", "n1", "n2", "node", "class_id", "copies").join(links, "node", "left").join(joined.join(heads, "component").select("node", "head"), "node", "left")
    result = result.select("label", "n1", "n2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("head", "class_id").alias("component_id"))
    result = settle(result, "vector-result", spent=(found, classes))
    linked = named.select("vec_id", "label", "n1", "n2").join(result, ["label", "n1", "n2"]).select("vec_id", "n_links", "component_id")
    usable = F.expr("vec_id is not null and label is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity')) and exists(vector, x -> x <> 0)")
    rest = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors of embeddings with cosine 0.93 or more within a label."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
