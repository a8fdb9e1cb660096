"""Session helpers: shared folder, lineage cuts, components of a link graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = "4m"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent, a local session (as in tests) takes a temporary
    folder of its machine; on a cluster that is an error.
    """
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        have = getattr(spark, "_strataline_folder", None) or tempfile.mkdtemp(prefix="strataline-")
        spark._strataline_folder = have
    return have.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in bytes for the session, unless it has a smaller bound: rows may hold long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().settings().get(key) is None:
        spark.conf.set(key, BATCH_BYTES)


def settle(df: DataFrame, name: str, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage ends there.

    spent: settled tables that nothing but df needs any more; they are deleted.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_folder(spark)}/strataline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in spent:
        discard(old)
    out = spark.read.schema(df.schema).parquet(path)
    out._strataline_path = path
    return out


def settle_dealt(df: DataFrame, name: str, key: str, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """The same, dealt by `key`: joins by that column read the rows where they lie, without a shuffle."""
    spark = df.sparkSession
    bound_batches(spark)
    named = f"strataline_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{named}"
    # fewer buckets than the session's partitions would be dealt anew
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(named)
    for old in spent:
        discard(old)
    out = spark.table(named)
    out._strataline_path, out._strataline_table = path, named
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table."""
    spark = df.sparkSession
    if hasattr(df, "_strataline_table"):
        spark.sql(f"DROP TABLE IF EXISTS {df._strataline_table}")
    where = spark._jvm.org.apache.hadoop.fs.Path(df._strataline_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names for a helper that df has not, in any case of letters: the given names, with underscores as needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, ...]:
    """df with its columns called c0, c1 ... in their order, and what the given ones are called now: no helper column can meet them."""
    plain = [f"c{k}" for k in range(len(df.columns))]
    return (df.toDF(*plain), *(plain[df.columns.index(name)] for name in names))


def numbered(df: DataFrame, order: list[Column], place: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with a column `place`: 1, 2, 3 ... in the given order, anew for each value of the columns `by`.

    Rows are dealt by ranges of the order and settled.  What goes to the driver
    and back is one row for each partition, or each partition and value of `by`
    that it holds; as the rows lie in the order of `by`, these are at most the
    partitions and the values together.
    """
    at, part, ahead, *same = fresh(df, "at", "part", "ahead", *by)
    keys = [F.col(c).asc_nulls_first() for c in by]
    # more partitions than the session's would only be smaller
    dealt = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, *order).sortWithinPartitions(*keys, *order)
    placed = settle(dealt.withColumn(at, F.monotonically_increasing_id()), name)
    low = (1 << 33) - 1  # an id holds the partition above 33 bits of the row's number in it
    held = placed.groupBy(F.shiftright(at, 33).alias(part), *(F.col(c).alias(s) for c, s in zip(by, same))).agg(F.count("*").alias("n"), F.min(F.col(at).bitwiseAND(low)).alias("first")).collect()
    before: dict[tuple, int] = {}
    starts = []
    for row in sorted(held, key=lambda row: row[0]):
        value = tuple(row[1:-2])
        starts.append((row[0], *value, before.get(value, 0) - row["first"] + 1))
        before[value] = before.get(value, 0) + row["n"]
    schema = ", ".join([f"{part} long", *(f"`{s}` {dict(df.dtypes)[c]}" for c, s in zip(by, same)), f"{ahead} long"])
    offsets = df.sparkSession.createDataFrame(starts, schema)
    match = F.shiftright(at, 33) == F.col(part)
    for c, s in zip(by, same):
        match &= F.col(c).eqNullSafe(F.col(s))
    return placed.join(F.broadcast(offsets), match).select(*df.columns, (F.col(at).bitwiseAND(low) + F.col(ahead)).alias(place))


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the column as text, modulo `modulus`."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links(a, b); component is the least node reachable.

    Rounds of large-star and small-star: each round joins the links with the
    least neighbour of each node, both distributed, until all links point at
    roots.  The rows of a hub meet in sort-merge joins only, which adaptive
    execution splits; its least neighbour comes from partial aggregates.  After
    ROUNDS rounds without an end (their number grows with the logarithm of the
    nodes) an error is raised.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every node keeps its own least neighbour, so that no link is lost
        large = large.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(small_least.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = settle(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", spent=(edges,))
        if not _open_nodes(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def _open_nodes(edges: DataFrame) -> int:
    """Nodes that point at several others, or point and are pointed at; none are left in a graph of stars."""
    ends = edges.select("u", F.lit(1).alias("goes"), F.lit(0).alias("comes")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("goes"), F.lit(1).alias("comes")))
    seen = ends.groupBy("u").agg(F.sum("goes").alias("goes"), F.max("comes").alias("comes"))
    return seen.agg(F.count_if((F.col("goes") > 1) | (F.col("goes") > 0) & (F.col("comes") > 0))).first()[0]
