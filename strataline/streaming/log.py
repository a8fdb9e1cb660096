"""Incremental forms of the log operators on Structured Streaming.

Sources and checkpoints are the caller's; each function is a plan over a
streaming DataFrame or a foreachBatch step that is idempotent when replayed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def once_per_key(stream: DataFrame, keys: list[str], event_time: str, late: str) -> DataFrame:
    """Rows whose key was not seen within the watermark; later rows than that are dropped."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def latest_per_key(stream: DataFrame, keys: list[str], line_no: str, values: list[str]) -> DataFrame:
    """The last row of each key by line number, as a running aggregate (update or complete mode)."""
    return stream.groupBy(*keys).agg(F.max_by(F.struct(line_no, *values), line_no).alias("_last")).select(*keys, "_last.*")


def windowed_counts(stream: DataFrame, event_time: str, late: str, width: str, keys: list[str]) -> DataFrame:
    """Counts in tumbling windows; a window is given once the watermark has passed it."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, width), *keys).agg(F.count("*").alias("n"))


def resumable(stream: DataFrame, checkpoint: str, done: Callable[[], DataFrame], keys: list[str], work: Callable[[DataFrame], None]) -> StreamingQuery:
    """Hands every micro-batch, without the keys that `done` lists, to `work`; resumes from the checkpoint."""

    def step(batch: DataFrame, _: int) -> None:
        work(batch.join(done().select(*keys).distinct(), keys, "left_anti"))

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
