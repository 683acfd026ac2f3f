"""Deterministic ids, cluster ids and the identity decision matrix."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sightledger.schema import IDENTITY_REASONS


def hashed_id(prefix: str, *parts: Column, length: int = 32) -> Column:
    digest = F.sha2(F.concat_ws("\n", *parts), 256)
    return F.concat(F.lit(prefix + "_"), F.substring(digest, 1, length))


def source_id(sha256: Column) -> Column:
    return F.concat(F.lit("src_"), F.substring(sha256, 1, 32))


def proposal_id(source: Column, raw_candidate_id: Column) -> Column:
    return hashed_id("prop", source, raw_candidate_id)


def cluster_id(member_ids: Column) -> Column:
    """Hash of the sorted member ids; ``member_ids`` is an array column."""
    return F.concat(F.lit("clu_"), F.substring(
        F.sha2(F.array_join(F.array_sort(member_ids), "\n"), 256), 1, 24
    ))


def resolve_identity(
    verdict: Column, hypothesis: Column, reviewed_object: Column,
    evidence_result: Column, evidence_object: Column,
) -> Column:
    """struct(decision, reason_code, reason); an ignored cluster decides nothing."""

    def outcome(decision: str, code: str, reason: str) -> Column:
        return F.struct(
            F.lit(decision).alias("decision"), F.lit(code).alias("reason_code"),
            F.lit(IDENTITY_REASONS[reason]).alias("reason"),
        )

    weak = "insufficient_evidence"
    none = F.struct(
        F.lit("ignored").alias("decision"),
        F.lit(None).cast("string").alias("reason_code"),
        F.lit(None).cast("string").alias("reason"),
    )
    return (
        F.when(verdict == "ignore", none)
        .when(verdict == "uncertain", outcome("uncertain", weak, "reviewer_uncertain"))
        .when(evidence_result == "ambiguous", outcome("uncertain", "ambiguous_match", "ambiguous"))
        .when((hypothesis == "new") & (evidence_result == "no_match"),
              outcome("new", "new_object", "new"))
        .when(hypothesis == "new", outcome("uncertain", weak, "new_but_matched"))
        .when((hypothesis == "existing") & (evidence_result == "match")
              & evidence_object.eqNullSafe(reviewed_object),
              outcome("existing", "visual_instance_match", "existing"))
        .otherwise(outcome("uncertain", weak, "existing_unsupported"))
    )
