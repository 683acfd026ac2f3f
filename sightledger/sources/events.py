"""Append-only event log as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightledger.schema import EVENT


def parse_event_lines(lines: DataFrame, after_sequence: int = 0) -> DataFrame:
    """Typed events from text lines; blank, malformed and non-object lines are skipped."""
    body = F.trim("value")
    parsed = F.from_json(body, EVENT, {"mode": "PERMISSIVE"})
    # Only an integer literal counts as a sequence.
    whole = F.get_json_object(body, "$.sequence").rlike(r"^-?[0-9]+$")
    return (
        lines.filter((body != "") & F.json_object_keys(body).isNotNull() & whole)
        .select(parsed.alias("e")).filter(F.col("e.sequence") > after_sequence).select("e.*")
    )


def read_events(spark: SparkSession, path: str, after_sequence: int = 0) -> DataFrame:
    return parse_event_lines(spark.read.text(path), after_sequence).orderBy("sequence")


def stream_events(spark: SparkSession, directory: str, max_files: int = 100) -> DataFrame:
    """Streaming twin: the query checkpoint takes the place of the cursor."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(directory)
    return parse_event_lines(lines)


def write_events(events: DataFrame, path: str) -> None:
    """One compact JSON object per line; an existing log is an error."""
    events.write.mode("error").option("ignoreNullFields", "false").json(path)
