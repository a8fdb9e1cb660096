"""Token counts by field or section (operator 2).

A document is encoded once, as a whole.  The byte lengths of its tokens give
their spans, and the spans are interval-joined with the sections of the
document, which lie in order and do not overlap.  A token that crosses a
boundary goes by a stated rule:

start     to the section that holds its first byte
end       to the section that holds its last byte
most      to the section that holds most of its bytes, the earlier one on a tie
share     to each section by its share of the token's bytes
"""

from __future__ import annotations

import base64
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import textkit as K
from strataline.llm.shared import table

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern by which this vocabulary splits a text before merging bytes: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "most", "share")

_encoders: dict[int, tuple] = {}


def _encoder(ranks: bytes, pattern: str):
    """The encoder of a task and the byte length of each token id, made once in a process."""
    name = hash((ranks, pattern))
    if name not in _encoders:
        import tiktoken

        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        size = np.zeros(max(table_.values()) + 1, np.int64)
        for token, rank in table_.items():
            size[rank] = len(token)
        _encoders[name] = (tiktoken.Encoding(f"ranks-{name}", pat_str=pattern, mergeable_ranks=table_, special_tokens={}), size)
    return _encoders[name]


def token_ends(text: str, ranks: bytes, pattern: str = PATTERN) -> np.ndarray:
    """End of each token of a text, in bytes."""
    encoder, size = _encoder(ranks, pattern)
    return np.cumsum(size[np.array(encoder.encode_ordinary(text), np.int64)])


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section and the number of tokens that cross a boundary.

    ends: token ends in bytes; bounds: section ends in bytes, in order.  Empty
    sections get nothing.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    n = len(bounds)
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    first = np.minimum(np.searchsorted(bounds, starts, side="right"), n - 1)
    last = np.minimum(np.searchsorted(bounds, ends - 1, side="right"), n - 1)
    crossing = np.flatnonzero(first != last)
    if rule in ("start", "end"):
        return np.bincount(first if rule == "start" else last, minlength=n).astype(float), len(crossing)
    inside = first == last
    count = np.bincount(first[inside], minlength=n).astype(float)
    edges = np.r_[0, bounds]
    for t in crossing.tolist():
        sections = np.arange(first[t], last[t] + 1)
        part = np.minimum(ends[t], edges[sections + 1]) - np.maximum(starts[t], edges[sections])
        if rule == "most":
            count[sections[part.argmax()]] += 1
        else:
            count[sections] += part / (ends[t] - starts[t])
    return count, len(crossing)


def _line_bounds(raw: np.ndarray) -> np.ndarray:
    """Ends of the lines of a text; a line holds its newline."""
    ends = np.flatnonzero(raw == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.r_[ends, len(raw)]


def _count(ranks, pattern: str, rule: str, given: bool):
    def run(batches):
        for batch in batches:
            data, offsets, _ = K.column_bytes(batch.column("text"))
            texts = batch.column("text").to_pylist()
            sections = batch.column("section_ends").to_pylist() if given else None
            n_tokens, n_crossing, counts = [], [], []
            for i, text in enumerate(texts):
                raw = data[offsets[i] : offsets[i + 1]]
                if given:
                    # ends are in characters
                    at = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]
                    bounds = at[np.minimum(np.array(sections[i] or [0], np.int64), len(at) - 1)]
                    bounds[-1] = len(raw)
                else:
                    bounds = _line_bounds(raw)
                ends = token_ends(text, ranks.value, pattern) if text else np.zeros(0, np.int64)
                share, crossing = allocate(ends, bounds, rule)
                n_tokens.append(len(ends))
                n_crossing.append(crossing)
                counts.append(share)
            offs = np.r_[0, np.cumsum([len(x) for x in counts])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n_tokens, pa.int64()), pa.array(n_crossing, pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([np.zeros(0), *counts])))], ["key", "n_tokens", "n_crossing", "section_tokens"])

    return run


def section_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", section_ends: str | Column | None = None, rule: str = "start", rank_file: str = RANK_FILE, pattern: str = PATTERN) -> DataFrame:
    """(key, n_tokens, n_crossing, section_tokens array<double>), one row per row of docs.

    section_ends: a column of increasing character offsets at which the sections
    end; without it the lines are the sections.  The last section takes what is
    left.  A null or empty text has no tokens and one empty section.  Keys may be
    null or repeated; other columns are not read.
    """
    spark = docs.sparkSession
    with open(rank_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    columns = [F.col(key).alias("key"), F.col(text).alias("text")]
    if section_ends is not None:
        columns.append((F.col(section_ends) if isinstance(section_ends, str) else section_ends).cast("array<long>").alias("section_ends"))
    rows = docs.select(*columns)
    return rows.mapInArrow(_count(ranks, pattern, rule, section_ends is not None), f"key {dict(rows.dtypes)['key']}, n_tokens long, n_crossing long, section_tokens array<double>")


def field_tokens(docs: DataFrame, key: str, fields: Sequence[str], joiner: str = "\n", rule: str = "start", rank_file: str = RANK_FILE) -> DataFrame:
    """Tokens of several text fields that are encoded as one document, joined by `joiner`.

    A joiner belongs to the field before it; null fields are empty.
    """
    parts = [F.coalesce(F.col(f), F.lit("")) for f in fields]
    parts = [F.concat(p, F.lit(joiner)) for p in parts[:-1]] + parts[-1:]
    ends = [sum((F.length(p) for p in parts[1 : k + 1]), F.length(parts[0])) for k in range(len(parts))]
    whole = docs.select(F.col(key), F.concat(*parts).alias("_whole"), F.array(*ends).alias("_ends"))
    return section_tokens(whole, key, "_whole", "_ends", rule, rank_file)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the lines of all documents; a crossing token belongs to the line it starts in."""
    found = section_tokens(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("key").alias("doc_id"), "n_tokens", F.size("section_tokens").cast("long").alias("n_sections"), "n_crossing",
        F.array_max("section_tokens").cast("long").alias("largest_section"), F.transform("section_tokens", lambda x: x.cast("long")).alias("section_tokens"),
    )
