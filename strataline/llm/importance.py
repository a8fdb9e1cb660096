"""Target-distribution importance resampling (operator 13).

A document's features are its runs of 1 to `most` consecutive words, hashed
into buckets by CRC-32.  A bucket's gain is the rounded logarithm of how much
more frequent it is in the target than in the documents; a document's weight is
the sum of its features' gains.  Gumbel noise, drawn from a hash of the id, is
added, and the highest scores are a draw without replacement in proportion to
exp(weight / 1000).

The features are read from the UTF-8 buffers of Arrow batches.  A lookup table
classifies every byte, differences of the classes give the starts and ends of
the words, and the CRC automaton, a table of 256 states, advances by one byte
at all starts at once.

Only bucket counts (one row for each bucket and task) and a few numbers for
each document are shuffled.  The gains have as many entries as there are
buckets, a parameter, and are broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import textkit as K
from strataline.llm.shared import fresh, numbered, table

BUCKETS = 10_000
MOST_WORDS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
LONG_BYTES = 2_048  # features go on beyond this length one by one


def _crc_steps() -> np.ndarray:
    """What the lowest byte of the CRC-32 register adds to the shifted register."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    return step


_STEP = _crc_steps()


def word_spans(low: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes; a word ends where its text does."""
    change = np.diff(K.WORD_BYTE[low].view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    inner = np.unique(bounds[(bounds > 0) & (bounds < len(low))])
    both = inner[K.WORD_BYTE[low[inner - 1]] & K.WORD_BYTE[low[inner]]] if len(inner) else inner
    if len(both):
        starts, ends = np.sort(np.r_[starts, both]), np.sort(np.r_[ends, both])
    return starts, ends


def crc_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] of every span, one byte of all spans at a time."""
    size = np.minimum(ends - starts, LONG_BYTES)
    order = np.argsort((LONG_BYTES - size).astype(np.uint16), kind="stable")  # longest first: the open spans are a prefix
    at = starts[order]
    open_ = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for j, n in enumerate(open_.tolist()):
        now = crc[:n]
        crc[:n] = _STEP[(now ^ data[at[:n] + j]) & 0xFF] ^ (now >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(ends - starts > LONG_BYTES).tolist():
        out[k] = zlib.crc32(data[starts[k] + LONG_BYTES : ends[k]].tobytes(), int(out[k]))
    return out


def features(data: np.ndarray, bounds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and text number of every feature, and the words of every text.

    bounds: the starts of the texts in data.
    """
    low = K.lower(data)
    starts, ends = word_spans(low, bounds)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    words = np.bincount(owner, minlength=len(bounds))
    if most == 1 or not len(starts):
        return crc_of_spans(low, starts, ends), owner, words
    # the words again, one space between them: a run of words is a span of these bytes
    size = ends - starts
    to = np.r_[0, np.cumsum(size + 1)[:-1]]
    joined = np.full(int(size.sum() + len(size)), 0x20, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = low[K.WORD_BYTE[low]]
    crcs, owners = [], []
    for n in range(1, most + 1):
        first = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]) if len(owner) >= n else np.zeros(0, np.int64)
        crcs.append(crc_of_spans(joined, to[first], to[first + n - 1] + size[first + n - 1]))
        owners.append(owner[first])
    return np.concatenate(crcs), np.concatenate(owners), words


def _pieces(column: pa.Array, most: int) -> Iterator[tuple]:
    data, offsets, _ = K.column_bytes(column)
    for a, b in K.pieces(offsets):
        yield a, b, *features(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], most)


def bucket_counts(rows: DataFrame, text: str = "text", most: int = MOST_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows each bucket holds; null texts have none.

    A task sends one row for each bucket it met, whatever the number of its rows.
    """

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, crc, _, _ in _pieces(batch.column(0), most):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in rows.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much more frequent a bucket is in the target, each bucket counting one more than it holds."""
    s, t, buckets = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def importance_weights(docs: DataFrame, gain: np.ndarray, text: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """docs with n_words, n_features and weight: the sum of the gains of each row's features.

    A null or empty text has none of either.  All other columns pass through,
    except those of these three names, which give way; repeated rows and null
    ids get a row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    kept = docs.drop("n_words", "n_features", "weight")
    place = kept.columns.index(text)

    def weigh(batches):
        gain = shared.value
        for batch in batches:
            for a, b, crc, owner, words in _pieces(batch.column(place), most):
                found = np.bincount(owner, minlength=b - a)
                order = np.argsort(owner, kind="stable") if most > 1 else slice(None)
                sums = np.r_[0, np.cumsum(gain[(crc % np.uint32(len(gain)))[order]])]
                stop = np.cumsum(found)
                added = [pa.array(x.astype(np.int64)) for x in (words, found, sums[stop] - sums[stop - found])]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *added], [*batch.schema.names, "n_words", "n_features", "weight"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(weigh, f"{fields}, n_words long, n_features long, weight long")


def add_scores(weighed: DataFrame, doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """weighed with score: the weight and a thousand times Gumbel noise, which the id decides; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, doc_id: str = "doc_id") -> DataFrame:
    """scored with rank: 1, 2, 3 … for the highest scores of rows of `least_words` words or more, null for the others.

    As many as floor(percent / 100) of those rows are drawn; ties go to the smaller
    id, a null one last, rows of one id and score to the one with fewer words.
    The order is a range shuffle over all rows, so no task holds it whole.
    """
    able, place = fresh(scored, "able", "place")
    rows = scored.withColumn(able, F.col("n_words") >= least_words)
    placed = numbered(rows, [F.col(able).desc(), F.col("score").desc(), F.col(doc_id).asc_nulls_last(), F.col("n_words")], place, "draw")
    n = placed.agg(F.count_if(able)).first()[0]
    drawn = F.col(able) & (F.col(place) <= percent * n // 100)
    return placed.select(*scored.columns, F.when(drawn, F.col(place)).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, carry: Sequence[str] = (), doc_id: str = "doc_id", text: str = "text", target_text: str = "text", most: int = MOST_WORDS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank, carry...) of every row of docs, drawn towards the target's words.

    Empty tables are fine: without a target every gain follows from the counts
    of docs alone, and without docs nothing is returned.
    """
    gain = gains(bucket_counts(docs, text, most, buckets), bucket_counts(target, target_text, most, buckets))
    weighed = importance_weights(docs.select(*dict.fromkeys([doc_id, text, *carry])), gain, text, most)
    kept = [doc_id, *(c for c in carry if c in weighed.columns and c not in (doc_id, "n_words", "n_features", "weight", "score", "rank")), "n_words", "n_features", "weight"]
    return draw(add_scores(weighed.select(*kept), doc_id, seed), percent, least_words, doc_id)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's draw: documents towards benchmark, by single words."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _words(name: str) -> str:
    return f"regexp_extract_all(translate(coalesce({name}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


#: CRC-32 by folding the bytes of each distinct word, with the table of its 256 steps made by the rule.
OP13_SQL = f"""
WITH step AS (
  SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
doc_word AS (SELECT r, unnest(w) AS w FROM doc),
item_word AS (SELECT unnest({_words('text')}) AS w FROM benchmark),
word AS (
  SELECT w, xor(list_reduce(list_transform(range(-1, octet_length(encode(w))), lambda i:
      CASE WHEN i < 0 THEN 4294967295 ELSE CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT) END),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM (SELECT w FROM doc_word UNION ALL SELECT w FROM item_word)), step),
source AS (SELECT bucket, count(*) AS s FROM doc_word JOIN word USING (w) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM item_word JOIN word USING (w) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM source) AS S_all, (SELECT coalesce(sum(t), 0) FROM target) AS T_all),
gain AS (
  SELECT source.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (S_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (T_all + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM source LEFT JOIN target USING (bucket), total),
weight AS (SELECT r, sum(g) AS weight FROM doc_word JOIN word USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM doc LEFT JOIN weight USING (r)),
able AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN rank <= 10 * n // 100 THEN rank END AS BIGINT) AS rank
FROM scored LEFT JOIN able USING (r)
"""
