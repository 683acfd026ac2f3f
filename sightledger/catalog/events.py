"""Event-log analytics, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightledger.catalog.registry import query
from sightledger.operators import events as E
from sightledger.session import shared_dir
from sightledger.sources.events import parse_event_lines
from sightledger.streaming.live import run_live_state, run_terminal_state

EVENTS = """
ev AS (
  SELECT 'run_' || user_id AS run_id, event_id, ts, event_type AS t, round(value, 3) AS elapsed, json_extract(props, '$.k')::INT AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
    CASE event_type WHEN 'view' THEN 'input_registration' WHEN 'click' THEN 'sam3' WHEN 'signup' THEN 'dinov3'
         WHEN 'purchase' THEN 'cluster_review' ELSE '' END AS stage FROM events),
st AS (
  SELECT *, CASE WHEN t = 'error' THEN CASE WHEN k % 2 = 0 THEN 'passed' ELSE 'failed' END ELSE 'running' END AS status,
    CASE WHEN t = 'error' THEN 'cli_completed' ELSE 'progress' END AS event,
    CASE WHEN t = 'view' THEN '' ELSE t END AS message,
    CASE t WHEN 'view' THEN 0 + 10 * k / 100.0::DOUBLE WHEN 'click' THEN 10 + 30 * k / 100.0::DOUBLE WHEN 'signup' THEN 40.0
           WHEN 'purchase' THEN 75 + 20 * k / 100.0::DOUBLE ELSE 0.0 END AS pct FROM ev),
latest AS (
  SELECT run_id, max(sequence) AS last_sequence, arg_max(event, sequence) AS last_event,
    arg_max(stage, sequence) FILTER (WHERE stage <> '') AS stage, arg_max(status, sequence) AS stage_status,
    arg_max(message, sequence) FILTER (WHERE message <> '') AS message, arg_max(elapsed, sequence) AS elapsed_seconds,
    arg_max(ts, sequence) AS last_event_at FROM st GROUP BY 1)
"""


def _sequenced(v):
    return E.assign_sequence(v.events(), "run_id", [F.col("timestamp_utc").asc(), F.col("event_id").asc()])


@query("assign_sequence", f"WITH {EVENTS} SELECT run_id, event_id, sequence FROM ev")
def assign_sequence(v):
    return _sequenced(v).select("run_id", "event_id", "sequence")


@query("read_events", f"""
WITH {EVENTS} SELECT run_id, sequence, message, elapsed AS elapsed_seconds FROM st WHERE event_id % 4 = 0 AND sequence > 5""")
def read_events(v):
    good = F.to_json(F.struct("sequence", "timestamp_utc", "run_id", "event", "stage", "status", "current",
                              "total", "message", "elapsed_seconds"))
    n = F.col("event_id") % 4
    line = (
        F.when(n == 0, good).when(n == 1, F.concat(F.lit("{broken "), good))
        .when(n == 2, F.lit("   ")).otherwise(F.concat(F.lit("["), good, F.lit("]")))
    )
    lines = _sequenced(v).select(line.alias("value"))
    return parse_event_lines(lines, after_sequence=5).select("run_id", "sequence", "message", "elapsed_seconds")


@query("monotonic_percent", f"""
WITH {EVENTS}
SELECT run_id, event_id, round(max(pct) OVER (PARTITION BY run_id ORDER BY sequence ROWS UNBOUNDED PRECEDING), 3) AS percent FROM st""")
def monotonic_percent(v):
    return E.monotonic_percent(_sequenced(v)).select("run_id", "event_id", "percent")


@query("latest_event_state", f"""
WITH {EVENTS} SELECT run_id, last_sequence, last_event, stage, stage_status, message, elapsed_seconds, last_event_at FROM latest""")
def latest_event_state(v):
    return E.latest_event_state(_sequenced(v)).drop("current", "total", "overall_percent")


@query("terminal_state", f"""
WITH {EVENTS},
rep AS (SELECT 'run_' || n_nationkey AS run_id, (['passed', 'failed', 'completed_with_errors'])[(n_nationkey % 3 + 1)] AS rs FROM nation),
j AS (SELECT l.*, rs, last_event = 'cli_completed' AS closed, coalesce(rs IN ('failed', 'completed_with_errors'), false) AS formal
      FROM latest l LEFT JOIN rep USING (run_id)),
k AS (SELECT *, CASE WHEN closed THEN stage_status WHEN formal THEN rs END AS result_status FROM j),
d AS (SELECT *, closed AND result_status = 'passed' AS done FROM k)
SELECT run_id, CASE WHEN done THEN 'completed' ELSE 'failed' END AS status, result_status, NOT done AND NOT formal AS unexpected_exit,
  CASE WHEN closed THEN last_event_at END AS completed_at,
  CASE WHEN done THEN 'Experiment completed.'
       WHEN NOT formal THEN 'Experiment process disappeared after service recovery; inspect process_error.log_tail.'
       ELSE 'Experiment finished with a failed result; inspect the report and audit trail.' END AS message FROM d""")
def terminal_state(v):
    return E.terminal_state(E.latest_event_state(_sequenced(v)), v.reports().select("run_id", "status"))


@query("image_state_merge", f"""
WITH {EVENTS},
r AS (SELECT run_id, sequence, CASE WHEN k % 3 <> 0 THEN 'in/' || (k % 20) || '.png' END AS input_path,
        CASE WHEN k % 3 <> 1 THEN 'src_' || (k % 10) END AS source_id, k,
        CASE WHEN t = 'view' THEN t END AS status, CASE WHEN t <> 'click' THEN k END AS kept FROM st),
m AS (SELECT DISTINCT run_id, input_path, source_id AS owner FROM r WHERE input_path IS NOT NULL AND source_id IS NOT NULL),
o AS (SELECT r.*, coalesce(r.source_id, m.owner, r.input_path) AS grp FROM r LEFT JOIN m ON m.run_id = r.run_id AND m.input_path = r.input_path)
SELECT run_id, arg_max(input_path, sequence) FILTER (WHERE input_path IS NOT NULL) AS input_path,
  arg_max(source_id, sequence) FILTER (WHERE source_id IS NOT NULL) AS source_id,
  arg_max(status, sequence) FILTER (WHERE status IS NOT NULL) AS status,
  arg_max(kept, sequence) FILTER (WHERE kept IS NOT NULL) AS kept FROM o GROUP BY run_id, grp""")
def image_state_merge(v):
    k, t = F.col("current"), F.col("message")
    rows = _sequenced(v).select(
        "run_id", "sequence",
        F.when(k % 3 != 0, F.concat(F.lit("in/"), (k % 20).cast("string"), F.lit(".png"))).alias("input_path"),
        F.when(k % 3 != 1, F.concat(F.lit("src_"), (k % 10).cast("string"))).alias("source_id"),
        F.when(t == "", "view").alias("status"), F.when(t != "click", k).alias("kept"))
    return E.image_state_merge(rows, ["status", "kept"]).drop("image_key")


@query("cluster_state_merge", f"""
WITH {EVENTS}
SELECT run_id, 'clu_' || (k % 5) AS cluster_id, arg_max(k, sequence) AS member_count,
  arg_max(t, sequence) FILTER (WHERE t <> 'view') AS final_decision FROM st GROUP BY ALL""")
def cluster_state_merge(v):
    rows = _sequenced(v).select(
        "run_id", "sequence", F.concat(F.lit("clu_"), (F.col("current") % 5).cast("string")).alias("cluster_id"),
        F.col("current").alias("member_count"), F.when(F.col("message") != "", F.col("message")).alias("final_decision"))
    return E.cluster_state_merge(rows, ["member_count", "final_decision"])


@query("live_run_state", """
SELECT user_id, max(event_id) AS last_sequence, arg_max(event_type, event_id) AS last_event, round(max(value), 3) AS elapsed_seconds,
  round(max(value / 10), 3) AS overall_percent,
  arg_max(event_type || ' ' || event_id, event_id) FILTER (WHERE event_type <> 'view') AS message
FROM events GROUP BY 1""")
def live_run_state(v):
    """The streaming form: events arrive as files, state is kept per run."""
    schema = v.table("events").schema
    stream = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.dir)
    events = stream.select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("sequence"),
        F.col("event_type").alias("event"), F.col("event_type").alias("stage"), F.col("event_type").alias("status"),
        (F.col("value") / 10).alias("overall_percent"), F.col("value").alias("elapsed_seconds"), F.col("ts").alias("timestamp_utc"),
        # An empty message keeps the last filled one.
        F.when(F.col("event_type") == "view", "").otherwise(F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))).alias("message"))
    state = run_live_state(events, shared_dir(v.spark))
    return state.select(F.col("run_id").cast("long").alias("user_id"), "last_sequence", "last_event",
                        F.round("elapsed_seconds", 3).alias("elapsed_seconds"),
                        F.round("overall_percent", 3).alias("overall_percent"), "message")


@query("silent_runs", """
WITH ev AS (
  SELECT 'run_' || user_id AS run_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'cli_completed' ELSE 'progress' END AS event,
    CASE WHEN event_type <> 'error' THEN 'running' WHEN json_extract(props, '$.k')::INT % 2 = 0 THEN 'passed' ELSE 'failed' END AS status FROM events),
l AS (SELECT run_id, arg_max(event, event_id) = 'cli_completed' AS closed, arg_max(status, event_id) AS stage_status,
        arg_max(ts, event_id) AS last_event_at, max(ts) AS seen FROM ev GROUP BY 1),
rep AS (SELECT 'run_' || n_nationkey AS run_id, (['passed', 'failed', 'completed_with_errors'])[(n_nationkey % 3 + 1)] AS rs FROM nation),
j AS (SELECT l.*, rs, coalesce(rs IN ('failed', 'completed_with_errors'), false) AS formal FROM l LEFT JOIN rep USING (run_id)
      WHERE closed OR epoch_ms(seen) + 86400000 < epoch_ms((SELECT max(ts) FROM events))),
d AS (SELECT *, closed AND stage_status = 'passed' AS done FROM j)
SELECT run_id, CASE WHEN done THEN 'completed' ELSE 'failed' END AS status, CASE WHEN closed THEN stage_status WHEN formal THEN rs END AS result_status,
  NOT done AND NOT formal AS unexpected_exit, CASE WHEN closed THEN last_event_at END AS completed_at FROM d""")
def silent_runs(v):
    """The streaming form: runs end by their closing event, or by a day without one while others report."""
    source = v.table("events")
    stream = v.spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(v.dir)
    k = F.get_json_object("props", "$.k").cast("int")
    closing = F.col("event_type") == "error"
    events = stream.select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("sequence"),
        F.when(closing, "cli_completed").otherwise("progress").alias("event"),
        F.when(~closing, "running").when(k % 2 == 0, "passed").otherwise("failed").alias("status"),
        F.col("value").alias("elapsed_seconds"), F.col("ts").alias("timestamp_utc"))
    ended = run_terminal_state(events, v.reports().select("run_id", "status"), shared_dir(v.spark), 86_400)
    return ended.select("run_id", "status", "result_status", "unexpected_exit",
                        F.col("completed_at").cast(source.schema["ts"].dataType).alias("completed_at"))
