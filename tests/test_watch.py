"""Runs that close, go silent, report again; restarts of the stream."""

from __future__ import annotations

from datetime import datetime, timedelta

from sightledger.streaming.live import ended_runs, start_terminal_state

EVENTS = "run_id string, sequence long, event string, status string, elapsed_seconds double, timestamp_utc timestamp"
START = datetime(2026, 1, 1)


def _arrive(spark, folder, rows):
    rows = [(r, n, e, s, float(n), None if at is None else START + timedelta(seconds=at)) for r, n, e, s, at in rows]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_silent_runs_and_restart(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    reports = spark.createDataFrame([("formal", "failed"), ("mute", "running")], "run_id string, status string")

    def drain():
        stream = spark.readStream.schema(EVENTS).parquet(source)
        start_terminal_state(stream, reports, path, checkpoint, 60, available_now=True).awaitTermination()
        return {r.run_id: (r.status, r.result_status, r.unexpected_exit) for r in ended_runs(spark, path).collect()}

    _arrive(spark, source, [
        ("done", 1, "progress", "running", 0), ("done", 2, "cli_completed", "passed", 1), ("mute", 1, "progress", "running", 0),
        ("formal", 1, "progress", "running", 5), ("back", 2, "progress", "running", 3), ("back", 1, "progress", "running", 2),
        ("live", 1, "progress", "running", 10), (None, 1, "progress", "running", 0), ("lost", 1, "progress", "running", None)])
    assert drain() == {"done": ("completed", "passed", False)}

    # The clock moves by what others report; three runs have said nothing for a minute.
    _arrive(spark, source, [("live", 2, "progress", "running", 100)])
    silent = {"mute": ("failed", None, True), "formal": ("failed", "failed", False)}
    assert drain() == {"done": ("completed", "passed", False), **silent, "back": ("failed", None, True)}

    # A restarted stream without news changes nothing.
    assert drain() == {"done": ("completed", "passed", False), **silent, "back": ("failed", None, True)}

    # A silent run reports again, then closes; an event behind the clock is late.
    _arrive(spark, source, [("back", 3, "progress", "running", 110), ("mute", 2, "cli_completed", "passed", 7)])
    assert drain() == {"done": ("completed", "passed", False), **silent}
    _arrive(spark, source, [("back", 4, "cli_completed", "failed", 120), ("live", 3, "progress", "running", 130)])
    assert drain() == {"done": ("completed", "passed", False), **silent, "back": ("failed", "failed", True)}


def test_many_events_of_one_run(spark, tmp_path):
    """A run holds nearly all events; they are folded before the shuffle and give one state."""
    source = str(tmp_path / "in")
    spark.range(50_000).selectExpr(
        "if(id % 1000 = 0, concat('r', id), 'hot') run_id", "id + 1 sequence", "if(id = 49999, 'cli_completed', 'progress') event",
        "if(id = 49999, 'passed', 'running') status", "double(id) elapsed_seconds", "timestamp_seconds(1767225600 + id) timestamp_utc",
    ).repartition(4).write.parquet(source)
    stream = spark.readStream.schema(EVENTS).parquet(source)
    start_terminal_state(stream, spark.createDataFrame([], "run_id string, status string"), str(tmp_path / "out"),
                         str(tmp_path / "checkpoint"), 10_000, available_now=True).awaitTermination()
    got = {r.run_id: r.status for r in ended_runs(spark, str(tmp_path / "out")).collect()}
    assert got == {"hot": "completed", **{f"r{i}": "failed" for i in range(0, 40_000, 1000) if i + 10_000 < 49_999}}
