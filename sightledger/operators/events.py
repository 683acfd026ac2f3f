"""Progress-event analytics: sequences, running percentages, latest state, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sightledger.functions.timing import stage_percent
from sightledger.operators.clustering import connected_components
from sightledger.schema import TERMINAL_MESSAGES
from sightledger.session import distributed_row_number, materialize

# Sequences are dense per run, so a block holds at most this many events of one run.
SEQUENCE_BLOCK = 65_536


def after_cursor(events: DataFrame, after_sequence: int = 0) -> DataFrame:
    return events.filter(F.col("sequence") > after_sequence)


def assign_sequence(events: DataFrame, key: str, order: list) -> DataFrame:
    """1..n per run in emit order."""
    return distributed_row_number(events, [key], order, "sequence")


def monotonic_percent(events: DataFrame, key: str = "run_id") -> DataFrame:
    """Running maximum of the computed percent by sequence, for runs of any length.

    Two levels: a running maximum inside blocks of consecutive sequences, and a running
    maximum over the (few) block maxima before each block.
    """
    raw = F.coalesce("overall_percent", stage_percent(
        F.col("stage"), F.col("status"), F.col("current"), F.col("total")))
    df = events.withColumn("_raw", raw).withColumn(
        "_block", F.floor(F.col("sequence") / SEQUENCE_BLOCK))
    tops = df.groupBy(key, "_block").agg(F.max("_raw").alias("_top"))
    earlier = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.withColumn("_before", F.max("_top").over(earlier)).select(key, "_block", "_before")
    inside = W.partitionBy(key, "_block").orderBy("sequence").rowsBetween(W.unboundedPreceding, 0)
    return (
        df.withColumn("_local", F.max("_raw").over(inside)).join(tops, [key, "_block"])
        .withColumn("percent", F.round(F.greatest("_local", F.coalesce("_before", F.lit(0.0))), 3))
        .drop("_raw", "_block", "_local", "_before")
    )


def latest_run(runs: DataFrame, *keys: str) -> DataFrame:
    """Newest run by (started_at desc, id desc), never by file time."""
    newest = F.max_by(F.struct("id", "started_at", "status"), F.struct("started_at", "id"))
    return runs.groupBy(*keys).agg(newest.alias("r")).select(*keys, "r.*")


def _last_filled(c: str) -> Column:
    return F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("sequence")))


def latest_event_state(events: DataFrame, key: str = "run_id") -> DataFrame:
    """Last event per run; an empty stage or message keeps the last filled one."""
    last = F.max_by(F.struct(
        "event", "status", "current", "total", "overall_percent", "elapsed_seconds", "timestamp_utc"
    ), F.col("sequence"))
    return events.groupBy(key).agg(
        F.max("sequence").alias("last_sequence"), last.alias("l"),
        _last_filled("stage").alias("stage"), _last_filled("message").alias("message"),
    ).select(
        key, "last_sequence", F.col("l.event").alias("last_event"), "stage",
        F.col("l.status").alias("stage_status"), F.col("l.current").alias("current"),
        F.col("l.total").alias("total"), F.col("l.overall_percent").alias("overall_percent"),
        "message", F.col("l.elapsed_seconds").alias("elapsed_seconds"),
        F.col("l.timestamp_utc").alias("last_event_at"),
    )


def terminal_state(states: DataFrame, reports: DataFrame, key: str = "run_id") -> DataFrame:
    """State of a run whose process is gone: completed only on the closing event and a
    passed result; a formal failure report; otherwise an unexpected exit."""
    r = reports.select(key, F.col("status").alias("_report"))
    closed = F.col("last_event") == "cli_completed"
    formal = F.coalesce(F.col("_report").isin("failed", "completed_with_errors"), F.lit(False))
    result = F.when(closed, F.col("stage_status")).when(formal, F.col("_report"))
    done = F.coalesce(closed & (result == "passed"), F.lit(False))
    message = (
        F.when(done, TERMINAL_MESSAGES["completed"]).when(~formal, TERMINAL_MESSAGES["unexpected"])
        .otherwise(TERMINAL_MESSAGES["failed"])
    )
    return states.join(r, key, "left").select(
        key, F.when(done, "completed").otherwise("failed").alias("status"),
        result.alias("result_status"), (~done & ~formal).alias("unexpected_exit"),
        F.when(closed, F.col("last_event_at")).alias("completed_at"), message.alias("message"),
    )


def _latest_fields(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per field, the last value that was present (null means the key was absent)."""
    seq = F.col("sequence")
    return df.groupBy(*keys).agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), seq)).alias(f) for f in fields])


def image_state_merge(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Coalesce image rows that share an input path or a source id; later values win.

    rows: run_id, sequence (report rows after all events), input_path, source_id, fields.
    A status is the first one filled of status and work_status (where given); an empty one
    never replaces an earlier one. A path with one source, and a source with one path, are
    the same image; only pairs in conflict are resolved as connected components.
    """
    if "status" in fields:
        filled = [F.nullif(F.trim(c), F.lit("")) for c in ("status", "work_status") if c in rows.columns]
        rows = rows.withColumn("status", F.coalesce(*filled))
    path = F.replace(F.trim(F.coalesce("input_path", F.lit(""))), F.lit("\\"), F.lit("/"))
    source = F.trim(F.coalesce("source_id", F.lit("")))
    df = rows.withColumn("_p", F.when(path != "", F.concat("run_id", F.lit("|input:"), path)))
    df = df.withColumn("_s", F.when(source != "", F.concat("run_id", F.lit("|source:"), source)))
    df = df.filter(F.coalesce("_p", "_s").isNotNull())
    aliases = df.filter(F.col("_p").isNotNull() & F.col("_s").isNotNull()).select(
        F.col("_p").alias("a"), F.col("_s").alias("b")).distinct()
    paths = aliases.groupBy("a").agg(F.count(F.lit(1)).alias("sources"))
    sources = aliases.groupBy("b").agg(F.count(F.lit(1)).alias("paths"))
    aliases = materialize(aliases.join(paths, "a").join(sources, "b"))
    alone = (F.col("sources") == 1) & (F.col("paths") == 1)
    pairs = aliases.filter(alone).withColumn("component", F.least("a", "b"))
    comp = pairs.select(F.col("a").alias("node"), "component").unionByName(pairs.select(F.col("b").alias("node"), "component"))
    tangled = aliases.filter(~alone).select("a", "b")
    if not tangled.isEmpty():
        comp = comp.unionByName(connected_components(tangled).select("node", "component"))
    key = F.coalesce("_p", "_s")
    merged = df.withColumn("node", key).join(comp, "node", "left").withColumn(
        "image_key", F.coalesce("component", "node"))
    return _latest_fields(merged, ["run_id", "image_key"], ["input_path", "source_id", *fields])


def cluster_state_merge(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Fold cluster rows, last value per field wins. A display sorts them by (member_count desc, id)."""
    merged = _latest_fields(rows.filter(F.coalesce("cluster_id", F.lit("")) != ""),
                            ["run_id", "cluster_id"], fields)
    return merged
