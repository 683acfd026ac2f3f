"""Read-side joins over the ledger: timelines, lineage, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _not_empty(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def latest_attempt(decisions: DataFrame) -> DataFrame:
    """Legacy rule: the decisions with the highest attempt of each proposal."""
    top = decisions.groupBy("proposal_id").agg(F.max("attempt").alias("attempt"))
    return decisions.join(top, ["proposal_id", "attempt"])


def object_timeline(
    observations: DataFrame, sources: DataFrame, proposals: DataFrame, decisions: DataFrame
) -> DataFrame:
    """All observations with their source, candidate and decision; `created_at`, then id, is the order of a timeline."""
    s = sources.select(F.col("id").alias("source_id"), F.col("relative_path").alias("source_path"))
    p = proposals.select(F.col("id").alias("proposal_id"), F.col("score").alias("candidate_score"))
    d = decisions.select(
        "proposal_id", "decision", "matched_object_id", F.col("confidence").alias("decision_confidence"),
        "reason_code", "hypothesis",
    )
    return (
        observations.join(p, "proposal_id").join(d, "proposal_id", "left").join(s, "source_id")
        .select(
            "object_id", F.col("created_at").alias("observed_at"), F.col("id").alias("observation_id"),
            "proposal_id", "source_id", "source_path", "candidate_score", "decision",
            "matched_object_id", "decision_confidence", "reason_code", "hypothesis",
        )
    )


def candidate_lineage(
    proposals: DataFrame, sources: DataFrame, decisions: DataFrame, observations: DataFrame
) -> DataFrame:
    """Every candidate with its source, decision and resulting object."""
    s = sources.select(
        F.col("id").alias("source_id"), "run_id", F.col("relative_path").alias("source_path"),
        F.col("status").alias("source_status"),
    )
    d = decisions.select(
        F.col("proposal_id").alias("id"), "decision", "matched_object_id",
        F.col("confidence").alias("decision_confidence"), "reason_code",
    )
    o = observations.select(
        F.col("proposal_id").alias("id"), F.col("id").alias("observation_id"),
        F.col("object_id").alias("observation_object_id"),
    )
    return (
        proposals.join(d, "id", "left").join(o, "id", "left").join(s, "source_id")
        .withColumn("object_id", F.coalesce(_not_empty("observation_object_id"), "matched_object_id"))
    )


def latest_objects(versions: DataFrame) -> DataFrame:
    """Objects are stored as versions; the highest one is current."""
    return versions.groupBy("id").agg(
        F.max_by("summary", "version").alias("summary"), F.max_by("status", "version").alias("status"),
        F.min("created_at").alias("created_at"),
    )


def object_catalog(objects: DataFrame, observations: DataFrame) -> DataFrame:
    """Objects with observation counts; the big side is aggregated before the join."""
    seen = observations.groupBy(F.col("object_id").alias("id")).agg(
        F.count(F.lit(1)).alias("observation_count"), F.max("created_at").alias("last_observed_at"))
    return objects.join(seen, "id", "left").select(
        "id", "status", "created_at",
        F.col("summary.object_name_zh").alias("object_name_zh"),
        F.col("summary.coarse_category").alias("coarse_category"),
        F.col("summary.fine_category").alias("fine_category"),
        F.col("summary.stable_description").alias("description"),
        F.col("summary.summary_confidence").alias("annotation_confidence"),
        F.coalesce("observation_count", F.lit(0).cast("long")).alias("observation_count"),
        "last_observed_at",
    )


def object_cards(objects: DataFrame) -> DataFrame:
    return objects.filter(F.col("status") == "active").select(
        F.col("id").alias("object_id"), "summary", "created_at"
    ).orderBy("created_at", "object_id")
