"""Streams run to the end of a table, by keyed state and timers, and the plan of a run that stops at its target."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataline.operators import ordering as O
from strataline.operators.staging import shared_folder
from strataline.sources import views as V
from strataline.sources.views import LOG, oracle
from strataline.streaming import state as S

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: A retry is due after an hour, twice as long after each attempt, three days at most; rows may come a day late.
BASE_MS, MOST_MS, MOST_ATTEMPTS, LATE_MS = 3_600_000, 3 * 86_400_000, 6, 86_400_000


def _log_stream(s, d):
    """The log of V.log without its occurrence numbers, as a stream over the events table."""
    # a pattern, as the table may be one file, which a stream's path must not be
    events = s.readStream.schema(V.table(s, d, "events").schema).parquet(f"{d}/events.parque[t]")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").alias("line_no"), F.element_at(F.array(*map(F.lit, ["ripple", "control", "pk", "gate"])), (F.col("event_id") % 4 + 1).cast("int")).alias("slot"),
        F.col("event_type").alias("model"), F.col("user_id").alias("case_id"), F.element_at(F.array(*map(F.lit, ["stick_new", "stick_old", "correct", "other"])), (k % 4 + 1).cast("int")).alias("label"),
        F.concat(F.lit("c"), (F.col("event_id") % 2).cast("string")).alias("contract_hash"), F.col("ts").cast("timestamp").alias("ts"),
    )


def _to_end(stream, mode):
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    return S.run_until_end(stream, f"{folder}/out", f"{folder}/checkpoint", mode)


def sm04(s, d):
    keys = ["model", "case_id", "contract_hash"]
    changes = _to_end(S.latest_changes(_log_stream(s, d).where("slot = 'gate'"), keys, "line_no", ["label"]), "update")
    return O.last_wins(changes, keys, "line_no").select(*keys, "line_no", "label")


QUERIES["sm04_latest_gate_stream"] = sm04
ORACLE_SQL["sm04_latest_gate_stream"] = oracle(LOG, body="SELECT model, case_id, contract_hash, max(line_no) AS line_no, arg_max(label, line_no) AS label FROM log WHERE slot = 'gate' GROUP BY 1, 2, 3")


def sm08(s, d):
    attempts = _log_stream(s, d).where("slot in ('gate', 'pk')").withColumn("final", F.col("label") == "correct")
    return _to_end(S.retries(attempts, "case_id", "line_no", "ts", "final", f"{LATE_MS} milliseconds", BASE_MS, MOST_MS, MOST_ATTEMPTS), "append")


QUERIES["sm08_retry_stream"] = sm08
ORACLE_SQL["sm08_retry_stream"] = oracle(
    LOG, "att AS (SELECT case_id, line_no, epoch_us(ts) // 1000 AS at_ms, label = 'correct' AS final FROM log WHERE slot IN ('gate', 'pk'))", "mark AS (SELECT max(at_ms) AS mark FROM att)",
    """n AS (SELECT *, row_number() OVER w AS n, lead(at_ms) OVER w AS next_ms, coalesce(bool_or(final) OVER (PARTITION BY case_id ORDER BY at_ms, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS closed
  FROM att WINDOW w AS (PARTITION BY case_id ORDER BY at_ms, line_no))""",
    f"due AS (SELECT *, at_ms + least({MOST_MS}, {BASE_MS} * CAST(pow(2, least(n - 1, 40)) AS BIGINT)) AS due_ms FROM n WHERE NOT closed AND NOT final AND n < {MOST_ATTEMPTS})",
    body=f"SELECT case_id, CAST(n + 1 AS INTEGER) AS attempt, due_ms FROM due, mark WHERE due_ms <= mark - {LATE_MS} AND (next_ms IS NULL OR next_ms > due_ms)",
)


def run_plan(s, d):
    """Runs still to be made, in the order of their names: not done, under the cap of attempts, and not behind the 20th admitted one."""
    runs = V.log(s, d).where("slot = 'gate'").groupBy(F.format_string("%d/%s", "case_id", "model").alias("run")).agg(F.count("*").alias("attempts"), F.count_if(F.col("label") == "correct").alias("done"))
    open_ = O.until_target(runs, "run", F.col("done") > 0, 20).where(f"done = 0 and attempts < {MOST_ATTEMPTS}")
    return open_.select("run", "attempts", F.least(F.lit(MOST_MS), BASE_MS * F.pow(F.lit(2), F.col("attempts") - 1)).cast("long").alias("delay_ms"))


QUERIES["sm08_run_plan"] = run_plan
ORACLE_SQL["sm08_run_plan"] = oracle(
    LOG, "runs AS (SELECT case_id || '/' || model AS run, count(*) AS attempts, count(*) FILTER (WHERE label = 'correct') AS done FROM log WHERE slot = 'gate' GROUP BY 1)",
    "seen AS (SELECT *, coalesce(sum(CAST(done > 0 AS INTEGER)) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM runs)",
    body=f"SELECT run, attempts, least({MOST_MS}, {BASE_MS} * CAST(pow(2, attempts - 1) AS BIGINT)) AS delay_ms FROM seen WHERE before < 20 AND done = 0 AND attempts < {MOST_ATTEMPTS}",
)
