"""Structured Streaming: event tail, live run state, runs that end or go silent, incremental ingestion."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightledger.operators.events import terminal_state
from sightledger.operators.registration import register_sources
from sightledger.params import Params
from sightledger.plans.run import Plugins, run_assets
from sightledger.sources.events import stream_events

__all__ = [
    "stream_events", "live_state", "run_live_state", "start_live_state", "start_ingestion",
    "start_resolution", "watch_runs", "start_terminal_state", "run_terminal_state",
]

CLOSING_EVENT = "cli_completed"


def live_state(events: DataFrame, key: str = "run_id") -> DataFrame:
    """Latest event and highest percent per run; the state is one row per run."""
    return events.groupBy(key).agg(
        F.max("sequence").alias("last_sequence"),
        F.max_by("event", "sequence").alias("last_event"),
        F.max_by("stage", F.when(F.coalesce("stage", F.lit("")) != "", F.col("sequence"))).alias("stage"),
        F.max_by("status", "sequence").alias("stage_status"),
        F.max("overall_percent").alias("overall_percent"),
        F.max_by("message", F.when(F.coalesce("message", F.lit("")) != "", F.col("sequence"))).alias("message"),
        F.max("elapsed_seconds").alias("elapsed_seconds"),
        F.max_by("timestamp_utc", "sequence").alias("last_event_at"),
    )


def _write_batches(df: DataFrame, path: str, checkpoint: str, mode: str, available_now: bool) -> StreamingQuery:
    """One directory per micro-batch: a replayed batch overwrites itself."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_live_state(events: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Update mode: only runs with new events are written per trigger."""
    return _write_batches(live_state(events), path, checkpoint, "update", available_now)


def run_live_state(events: DataFrame, folder: str) -> DataFrame:
    """Drain what is available and return the current state per run."""
    base = f"{folder.rstrip('/')}/live_{uuid.uuid4().hex}"
    start_live_state(events, f"{base}/state", f"{base}/checkpoint", available_now=True).awaitTermination()
    rows = events.sparkSession.read.parquet(f"{base}/state")
    fields = [c for c in rows.columns if c not in ("run_id", "batch_id")]
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*fields), "batch_id").alias("s")).select("run_id", "s.*")


_EVENT = "run_id string, sequence long, event string, status string, elapsed_seconds double, at_us long, seen_us long"
_WATCHED = ("run_id string, state string, last_sequence long, last_event string, stage_status string, elapsed_seconds double, "
            "last_us long")


def _last_per_run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per run and Arrow batch, before the shuffle: the event of the highest sequence, and the latest time seen."""
    for rows in batches:
        if len(rows):
            last = rows.sort_values("sequence", kind="stable").drop_duplicates("run_id", keep="last")
            yield last.assign(seen_us=last["run_id"].map(rows.groupby("run_id")["seen_us"].max()))


def watch_runs(events: DataFrame, silence_seconds: int, delay_seconds: int = 0) -> DataFrame:
    """Stream of run states: ``running`` or ``closed`` with new events, ``silent`` once the stream's clock is
    ``silence_seconds`` past the newest event of a run that was not closed.

    The clock is the watermark: the newest event of any run less ``delay_seconds``. Events older than it are late and
    change nothing. A silent run that reports again runs again. State is one row per run and goes with the silence, for
    closed runs too. Events without run, sequence or time are ignored; of equal sequences in a micro-batch one counts.
    """
    silence_ms = silence_seconds * 1000

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.getOption
        if state.hasTimedOut:
            state.remove()
            name = None if last[1] == CLOSING_EVENT else "silent"
        else:
            for rows in batches:
                for r in rows.itertuples(index=False):
                    seen = max(int(r.seen_us), last[5] if last else int(r.seen_us))
                    if last is None or r.sequence >= last[0]:
                        last = (int(r.sequence), r.event, r.status, float(r.elapsed_seconds), int(r.at_us), seen)
                    else:
                        last = (*last[:5], seen)
            name = "closed" if last[1] == CLOSING_EVENT else "running"
            deadline = last[5] // 1000 + silence_ms
            if deadline > state.getCurrentWatermarkMs():
                state.update(last)
                state.setTimeoutTimestamp(deadline)
            else:
                # The clock has passed it already.
                if state.exists:
                    state.remove()
                name = "silent" if name == "running" else name
        if name:
            yield pd.DataFrame([(key[0], name, *last[:5])], columns=[
                "run_id", "state", "last_sequence", "last_event", "stage_status", "elapsed_seconds", "last_us"])

    at = F.unix_micros(F.col("timestamp_utc").cast("timestamp"))
    rows = events.select(
        "run_id", F.col("sequence").cast("long").alias("sequence"), "event", "status",
        F.col("elapsed_seconds").cast("double").alias("elapsed_seconds"), at.alias("at_us"), at.alias("seen_us"),
    ).filter("run_id is not null and sequence is not null and at_us is not null").mapInPandas(_last_per_run, _EVENT)
    rows = rows.withColumn("seen_at", F.timestamp_micros("seen_us")).withWatermark("seen_at", f"{delay_seconds} seconds")
    states = rows.groupBy("run_id").applyInPandasWithState(
        watch, _WATCHED, "sequence long, event string, status string, elapsed double, at_us long, seen_us long",
        "update", GroupStateTimeout.EventTimeTimeout)
    return states.withColumn("last_event_at", F.timestamp_micros("last_us")).drop("last_us")


def start_terminal_state(
    events: DataFrame, reports: DataFrame, path: str, checkpoint: str, silence_seconds: int, delay_seconds: int = 0,
    available_now: bool = False,
) -> StreamingQuery:
    """Resolve runs that closed or went silent, batch by batch, with the same ladder as the batch query.

    A run that goes on is written as ``running``, which replaces an earlier end. One directory per micro-batch: a
    replayed batch overwrites itself.
    """
    def close(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        ended = terminal_state(batch.filter("state <> 'running'"), reports)
        on = batch.filter("state = 'running'").select("run_id", F.col("state").alias("status"))
        ended.unionByName(on, allowMissingColumns=True).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.unpersist()

    writer = watch_runs(events, silence_seconds, delay_seconds).writeStream.outputMode("update").option(
        "checkpointLocation", checkpoint).foreachBatch(close)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def ended_runs(spark, path: str) -> DataFrame:
    """The newest state of every run in a folder of ``start_terminal_state``, without those that go on."""
    rows = spark.read.parquet(path)
    fields = [c for c in rows.columns if c not in ("run_id", "batch_id")]
    newest = rows.groupBy("run_id").agg(F.max_by(F.struct(*fields), "batch_id").alias("s"))
    return newest.select("run_id", "s.*").filter("status <> 'running'")


def run_terminal_state(events: DataFrame, reports: DataFrame, folder: str, silence_seconds: int) -> DataFrame:
    """Drain what is available and return the runs that ended or went silent."""
    base = f"{folder.rstrip('/')}/ended_{uuid.uuid4().hex}"
    start_terminal_state(events, reports, f"{base}/state", f"{base}/checkpoint", silence_seconds,
                         available_now=True).awaitTermination()
    return ended_runs(events.sparkSession, f"{base}/state")


def known_sources(stored: DataFrame) -> DataFrame:
    """One row per hash: its newest status."""
    newest = F.max_by(F.struct("run_id", "status"), "batch_id").alias("s")
    return stored.groupBy("sha256").agg(newest).select("sha256", "s.run_id", "s.status")


def start_ingestion(
    incoming: DataFrame, known_path: str, checkpoint: str, run_id: str, available_now: bool = False,
    process: Callable[[DataFrame, int], DataFrame] | None = None,
) -> StreamingQuery:
    """Register arriving assets against the stored hashes; seen content is skipped.

    ``process(rows, batch_id)`` resolves the accepted rows of a batch and returns
    (sha256, status); without it content counts as completed once it is registered.
    known_path holds one directory per batch (batch_id = -1 for what existed before), so
    a replayed batch sees exactly what it saw the first time and overwrites itself.
    """
    def ingest(batch: DataFrame, batch_id: int) -> None:
        known = batch.sparkSession.read.parquet(known_path).filter(F.col("batch_id") < batch_id)
        rows = batch.withColumn("run_id", F.lit(run_id))
        done = register_sources(rows, known_sources(known)).filter(F.col("outcome").isin("new", "resumed"))
        if process is None:
            states = done.select("sha256", "run_id", F.lit("completed").alias("status"))
        else:
            states = process(done, batch_id).select("sha256", F.lit(run_id).alias("run_id"), "status")
        states.write.mode("overwrite").parquet(f"{known_path}/batch_id={batch_id}")

    writer = incoming.writeStream.option("checkpointLocation", checkpoint).foreachBatch(ingest)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_resolution(
    incoming: DataFrame, root: str, plugins: Plugins, p: Params, prefix: str, at: datetime, checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Arriving assets (path, name, content) become runs: one per micro-batch, named after it.

    A batch meets the sources, objects and views of all earlier ones in the ledger at ``root``. Its number is its
    run id, so a batch that is replayed goes on where its run was stopped, and changes nothing if that was closed.
    """
    def resolve(batch: DataFrame, batch_id: int) -> None:
        run_assets(batch.sparkSession, root, batch, plugins, p, f"{prefix}_{batch_id}", at)

    writer = incoming.writeStream.option("checkpointLocation", checkpoint).foreachBatch(resolve)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
