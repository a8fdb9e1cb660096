"""Many patterns at once: mentions of aliases and leaks of secrets, by an Aho-Corasick automaton.

The patterns go to the tasks in blocks of at most about PATTERN_BYTES, each of
which is one scan of the texts; a worker builds the automaton of a block once.
Texts are read where they lie: no text is shuffled, and no pair of a text and a
pattern is formed that is not a hit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

PATTERN_BYTES = 2 << 20
_HITS = 1 << 15

_built: dict[str, tuple] = {}


def fold_case(text: str) -> str:
    """Lower case by characters, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _automaton(shared: Broadcast):
    """The automaton of a broadcast block, its name and its (number, pattern), made once in a process; None for an empty block."""
    import ahocorasick

    name, rows = shared.value
    if name not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        numbers: dict[str, list[int]] = {}
        for number, pattern in rows:
            numbers.setdefault(fold_case(pattern), []).append(number)
        for pattern, own in numbers.items():
            made.add_word(pattern, (len(pattern), own))
        if numbers:
            made.make_automaton()
        _built[name] = (made if numbers else None,)
    return _built[name][0]


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _hits(automaton, text: str, whole_word: bool) -> Iterator[tuple[int, list[int]]]:
    low = fold_case(text)
    for last, (size, own) in automaton.iter(low):
        start = last - size + 1
        if not whole_word or not (start and _in_word(low[start - 1]) or last + 1 < len(low) and _in_word(low[last + 1])):
            yield start, own


def _blocks(patterns: DataFrame, pattern: str) -> tuple[DataFrame, list[Broadcast]]:
    """patterns with a number, and their texts in broadcast blocks.

    Only patterns that are not empty; a number is the pattern's place in its
    block, with the block's number above it.
    """
    spark = patterns.sparkSession
    some = patterns.where(F.col(pattern).isNotNull() & (F.col(pattern) != "")).select(pattern).distinct()
    n = -(-(some.agg(F.sum(F.octet_length(pattern))).first()[0] or 0) // PATTERN_BYTES) or 1
    blocks, named = [], []
    for k in range(n):
        texts = sorted(r[0] for r in some.where(F.pmod(F.xxhash64(pattern), F.lit(n)) == k).collect())
        blocks.append(spark.sparkContext.broadcast((uuid.uuid4().hex, [(k << 32 | i, t) for i, t in enumerate(texts)])))
        named += [(k << 32 | i, t) for i, t in enumerate(texts)] if n == 1 else []
    if n == 1:
        return spark.createDataFrame(named, "_number long, _pattern string"), blocks
    # more than a block: the numbers are told again by the tasks, from the broadcast blocks
    told = spark.range(n).repartition(n, "id").mapInArrow(_tell(blocks), "_number long, _pattern string")
    return told, blocks


def _tell(blocks: list[Broadcast]):
    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                rows = blocks[k].value[1]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["_number", "_pattern"])

    return run


def find_patterns(texts: DataFrame, patterns: DataFrame, keys: list[str], text: str, pattern_key: str, pattern: str, whole_word: bool = True) -> DataFrame:
    """(keys, pattern_key, n, first): the patterns that stand in each text, how often, and where first (in characters, from 0).

    Case does not matter.  whole_word: no letter, digit or underscore of any
    script stands beside the pattern.  Occurrences may overlap.  Null and empty
    patterns are in no text; equal patterns with several keys are found for each;
    a repeated row of either side gives its hits again.
    """
    numbers, blocks = _blocks(patterns, pattern)
    rows = texts.where(F.col(text).isNotNull()).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(text).alias("_text"))
    found_schema = StructType([*rows.schema.fields[:-1], *(StructField(c, LongType()) for c in ("_number", "_n", "_first"))])
    arrow = to_arrow_schema(found_schema)

    def scan(shared: Broadcast):
        def run(batches):
            automaton = _automaton(shared)
            for batch in batches if automaton else ():
                held: list[tuple] = []
                columns = batch.columns[:-1]

                def give():
                    row = pa.array([x[0] for x in held], pa.int64())
                    made = [c.take(row) for c in columns] + [pa.array([x[k] for x in held], pa.int64()) for k in (1, 2, 3)]
                    return pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(made, arrow)], schema=arrow)  # noqa: B023

                for i, t in enumerate(batch.columns[-1].to_pylist()):
                    met: dict[int, list[int]] = {}
                    for start, own in _hits(automaton, t, whole_word):
                        for number in own:
                            seen = met.get(number)
                            if seen is None:
                                met[number] = [1, start]
                            else:
                                seen[0] += 1
                                seen[1] = min(seen[1], start)
                    held += [(i, number, *x) for number, x in met.items()]
                    if len(held) >= _HITS:
                        yield give()
                        held.clear()
                if held:
                    yield give()

        return run

    hits = None
    for shared in blocks:
        part = rows.mapInArrow(scan(shared), found_schema)
        hits = part if hits is None else hits.unionByName(part)
    named = patterns.select(F.col(pattern_key).alias("_pattern_key"), F.col(pattern).alias("_pattern")).join(numbers, "_pattern").select("_pattern_key", "_number")
    joined = hits.join(named, "_number")
    return joined.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), F.col("_pattern_key").alias(pattern_key), F.col("_n").alias("n"), F.col("_first").alias("first"))


def count_patterns(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, name: str, whole_word: bool = True) -> DataFrame:
    """texts with a column `name`: how many different patterns stand in each text; nothing is shuffled.

    The texts go through the blocks of patterns one after the other.  A null text
    has none.
    """
    place = texts.columns.index(text)
    out = texts.withColumn(name, F.lit(0).cast("long"))

    def count(shared: Broadcast):
        def run(batches):
            automaton = _automaton(shared)
            for batch in batches:
                before = batch.column(batch.num_columns - 1).to_pylist()
                more = [len({n for _, own in _hits(automaton, t, whole_word) for n in own}) if t and automaton else 0 for t in batch.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([a + b for a, b in zip(before, more)], pa.int64())], batch.schema.names)

        return run

    schema = out.schema
    for shared in _blocks(patterns, pattern)[1]:
        out = out.mapInArrow(count(shared), schema)
    return out

