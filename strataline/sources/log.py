"""Reading and writing logs, documents and state tables."""

from __future__ import annotations

import functools
import itertools
import operator
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.functions.digest import Sha256
from strataline.operators.staging import bounded_batches, settle, shared_folder

WHOLE = 64 << 20  # bytes of a file that is hashed as one value
STRETCH = 128 << 20  # bytes of a longer file that one task hashes
_PART = 256 << 10  # bytes of a piece, but for one line more
_CODED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst")  # the text reader would unpack these
_BOM = b"\xef\xbb\xbf"  # the text reader leaves it out
_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 10, "parquet.enable.dictionary": "false", "compression": "none"}  # few long values
_PIECE = "id int, block long, seq long, bytes binary, n long, stretch long"
_STATE = "id int, bytes binary, rest long, sha256 string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files of any size, read by splits.

    A split's lines are numbered in order; the counts of a file's earlier splits,
    one row for each split, are added.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_at"))
    splits = lines.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return lines.join(splits, ["file", "_block"]).select("file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "line")


def read_lines(spark: SparkSession, path: str, schema: str, fail_fast: bool = False) -> DataFrame:
    """JSON lines with their file and line number; blank lines count but give no row.

    Bad lines come back with `corrupt` set, or abort the read with fail_fast.
    """
    text = numbered_lines(spark, path).where(F.trim("line") != "")
    parsed = text.withColumn("row", F.from_json("line", schema + ", corrupt string", {"mode": "FAILFAST" if fail_fast else "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}))
    return parsed.select("file", "line_no", "row.*")


def read_documents(spark: SparkSession, path: str, schema: T.StructType, key: str, version: str | None = None) -> DataFrame:
    """JSON documents under an explicit schema; duplicate keys or another schema_version are errors."""
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    if version is not None:
        bad = docs.where(F.col("schema_version") != version).limit(1).count()
        if bad:
            raise ValueError(f"schema_version is not {version}")
    if docs.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"duplicate {key}")
    return docs


def append_new(df: DataFrame, path: str, slots: list[str] | None = None) -> None:
    """Writes a result store; an existing one is an error."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*slots) if slots else writer).parquet(path)


def append_more(df: DataFrame, path: str) -> None:
    """Adds rows to a result store that exists; one that does not is an error."""
    where, files = _path(df.sparkSession, path)
    if not files.exists(where):
        raise ValueError(f"no store at {path}")
    df.write.mode("append").parquet(path)


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    where, files = _path(spark, path)
    if not files.exists(where):
        return []
    return sorted(int(x.getPath().getName()[1:]) for x in files.listStatus(where) if x.getPath().getName()[0] == "v")


def replace_document(df: DataFrame, path: str, refuse: bool = False) -> None:
    """Replaces a JSON document whole: a new version is staged and renamed to the next number in one step.

    The document is its version of the greatest number, so readers see the old
    one or the new one, and a writer that dies leaves the old one.  The version
    before stays for readers that have begun; older ones go.  With `refuse` an
    existing document is an error and stays.
    """
    spark, hadoop = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs
    have = _versions(spark, path)
    if refuse and have:
        raise FileExistsError(path)
    stage, files = _path(spark, f"{path}/_new-{uuid.uuid4().hex}")
    df.write.json(stage.toString())
    context = hadoop.FileContext.getFileContext(stage.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    number = have[-1] + 1 if have else 0
    while True:
        try:
            context.rename(files.makeQualified(stage), files.makeQualified(hadoop.Path(f"{path}/v{number:09d}")), no_overwrite)
            break
        except Exception as error:  # another writer was first
            if "FileAlreadyExists" not in str(error):
                raise
            if refuse:
                files.delete(stage, True)
                raise FileExistsError(path) from error
            number += 1
    for old in have[:-1]:
        files.delete(hadoop.Path(f"{path}/v{old:09d}"), True)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The document at a path as it is now, or None."""
    have = _versions(spark, path)
    return spark.read.schema(schema).json(f"{path}/v{have[-1]:09d}") if have else None


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and rows of old whose keys new has not."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def ledger_merge(state: DataFrame, batch: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Attempts add up, the first sighting stays, the last status of the batch by line number wins.

    state: key, attempts, first_seen, status.  batch: key, seen, status, line_no.
    """
    new = batch.groupBy(key).agg(F.count("*").alias("_n"), F.min("seen").alias("_seen"), F.max_by("status", "line_no").alias("_status"))
    return state.join(new, key, "full").select(
        key, (F.coalesce("attempts", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("attempts"), F.least("first_seen", "_seen").alias("first_seen"), F.coalesce("_status", "status").alias("status"),
    )


def cached_misses(requests: DataFrame, cache: DataFrame, parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with their cached response, misses) by the SHA-256 of the request's parts."""
    keyed = requests.withColumn("cache_key", F.sha2(F.concat_ws("\x1f", *parts), 256))
    return keyed.join(cache, "cache_key"), keyed.join(cache, "cache_key", "left_anti")


def content_address(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *columns), 256)


def _pieces(stretch: int) -> Callable:
    """Lines of splits in their order -> pieces of them, with their places and the stretch in which each begins."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, fed = None, 0, 0
        for batch in batches:
            file, block, last = (batch.column(c).to_numpy() for c in ("id", "block", "last"))
            size = np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy(), dtype=np.int64) // _PART
            ends = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0) | (np.diff(size) != 0)) + 1
            for lo, hi in itertools.pairwise([0, *ends.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                if at != (file[lo], block[lo]):
                    at, seq, fed = (file[lo], block[lo]), 0, 0
                lines = batch.column("bytes").slice(lo, hi - lo)
                piece = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), lines), pa.scalar(b"", lines.type))
                n = pc.binary_length(piece)[0].as_py()
                # the last line of a split may reach into the next one, whose lines come after it
                place = min(int(block[lo]) + fed, int(last[lo])) // stretch
                columns = [pa.array([v], kind) for v, kind in ((file[lo], pa.int32()), (block[lo], pa.int64()), (seq, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, piece, pa.array([n], pa.int64()), pa.array([place], pa.int64())], ["id", "block", "seq", "bytes", "n", "stretch"])
                seq, fed = seq + 1, fed + n

    return cut


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by file, its state (block -1) before its pieces -> the states after them, with the digest where nothing is to come."""
    file, rest, hashed = None, 0, None

    def told() -> pa.RecordBatch:
        row = (file, hashed.state(), rest, None if rest else hashed.hexdigest())
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, (pa.int32(), pa.binary(), pa.int64(), pa.string()))], ["id", "bytes", "rest", "sha256"])

    for batch in batches:
        for k, (number, block, left) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "block", "rest")))):
            data = batch.column("bytes")[k].as_py()
            if block < 0:
                if file is not None:
                    yield told()
                file, rest, hashed = number, left, Sha256(data)
            elif number == file:
                data = data if len(data) <= rest else data[:rest]  # a last line without its line feed
                hashed.update(data)
                rest -= len(data)
    if file is not None:
        yield told()


def _hash_stretches(listed: DataFrame, texts: DataFrame, folder: str) -> None:
    """Writes the states of the listed files after each round of stretches to the folder; those at a file's end have its digest."""
    spark = listed.sparkSession
    start, size = F.col("_metadata.file_block_start"), F.col("_metadata.file_block_length")
    lines = texts.select(F.col("_metadata.file_path").alias("key"), start.alias("block"), (start + size - 1).alias("last"), F.concat("value", F.lit("\n")).cast("binary").alias("bytes"))
    lines = lines.join(F.broadcast(listed.select("id", "key")), "key").select("id", "block", "last", "bytes")
    lines.mapInArrow(_pieces(STRETCH), _PIECE).write.options(**_ROWS).partitionBy("stretch").parquet(f"{folder}/pieces")
    pieces = spark.read.schema(_PIECE).parquet(f"{folder}/pieces")

    fresh, marked = Sha256(), Sha256()
    marked.update(_BOM)
    missing = F.col("length") - F.coalesce("total", F.lit(0))
    mark = missing >= 2
    # a line feed more than there is (-1) or none, with or without the three bytes of the mark
    known = listed.join(pieces.groupBy("id").agg(F.sum("n").alias("total")), "id", "left").where(missing.isin(-1, 0, 2, 3))
    known.select("id", F.when(mark, F.lit(marked.state())).otherwise(F.lit(fresh.state())).alias("bytes"), (F.col("length") - F.when(mark, 3).otherwise(0)).alias("rest"), F.lit(None).cast("string").alias("sha256")).write.parquet(f"{folder}/states/round=0")
    # files are numbered from the longest on, so those that have a stretch have the first numbers
    rounds = pieces.groupBy("stretch").agg(F.max("id") + 1).orderBy("stretch").collect()
    for k, (stretch, n) in enumerate(rounds):
        part = spark.read.schema(_PIECE).parquet(f"{folder}/pieces/stretch={stretch}").select("id", "block", "seq", "bytes", F.lit(None).cast("long").alias("rest"))
        state = spark.read.schema(_STATE).parquet(f"{folder}/states/round={k}").where("rest > 0").select("id", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("seq"), "bytes", "rest")
        rows = state.unionByName(part).repartitionById(n, F.pmod("id", F.lit(n))).sortWithinPartitions("id", "block", "seq")
        rows.mapInArrow(_chain, _STATE).write.parquet(f"{folder}/states/round={k + 1}")
    where, store = _path(spark, f"{folder}/pieces")
    store.delete(where, True)


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files; the SHA-256 is that of the bytes of the whole file.

    Files of up to WHOLE bytes are values of one task.  Longer ones are read by
    splits of the text reader, which gives every byte between two line feeds as
    it is, and written as pieces by stretches of STRETCH bytes.  SHA-256 is one
    chain over a file, so the stretches are hashed one after the other, those
    of all files at once, and the state goes from round to round: 112 bytes a
    file.  A task reads a stretch of one file, however long the file is.

    Files that the text reader would unpack, and others that it does not give
    whole, are values of one task at any length.
    """
    files = spark.read.format("binaryFile").load(path)
    most = min(WHOLE, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(WHOLE))))
    name = F.col("_metadata.file_path")
    long = functools.reduce(operator.and_, (~F.endswith(name, F.lit(end)) for end in _CODED), F.col("_metadata.file_size") > most)
    fingerprint = ("path", "length", F.sha2("content", 256).alias("sha256"))
    whole = files.where(~long).select(*fingerprint)
    if files.where(long).isEmpty():
        return whole
    # a row for each file of over WHOLE bytes, so these are few enough to be numbered in one task and broadcast
    listed = settle(files.where(long).select((F.row_number().over(Window.orderBy(F.desc("length"), "path")) - 1).alias("id"), name.alias("key"), "path", "length"), "files")
    folder = f"{shared_folder(spark)}/fingerprints-{uuid.uuid4().hex}"
    with bounded_batches(spark):
        _hash_stretches(listed, spark.read.option("lineSep", "\n").text(path).where(long), folder)
    done = spark.read.schema(_STATE).parquet(f"{folder}/states").where("sha256 is not null").join(listed, "id").select("key", "path", "length", "sha256")
    out = whole.unionByName(done.drop("key"))
    odd = [r.key for r in listed.join(done, "key", "left_anti").select("key").collect()]
    return out.unionByName(files.where(name.isin(odd)).select(*fingerprint)) if odd else out


def write_scores(df: DataFrame, path: str) -> None:
    """A score report as CSV with a header; an existing one is an error."""
    df.write.mode("errorifexists").option("header", True).csv(path)
