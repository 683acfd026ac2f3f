"""Content-hash inventory and source registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightledger.functions.identity import source_id
from sightledger.functions.validators import upload_codes
from sightledger.session import materialize


def _first_per(df: DataFrame, key: str, value, order) -> DataFrame:
    """Value of the first row of each key: a partial aggregate, so hot keys combine early."""
    return df.groupBy(key).agg(F.min_by(value, order).alias("_first"))


def digests(assets: DataFrame) -> DataFrame:
    """All columns but the content, and its hash, stored: whatever follows reads no content again."""
    return materialize(assets.withColumn("sha256", F.sha2("content", 256)).drop("content"))


def asset_inventory(assets: DataFrame) -> DataFrame:
    """Mark content duplicates; the first path (case-folded order) owns the content."""
    hashed = digests(assets)
    order = F.struct(F.lower("path").alias("l"), F.col("path").alias("p"))
    owner = _first_per(hashed, "sha256", F.col("path"), order)
    same = F.col("path") == F.col("_first")
    return (
        hashed.join(owner, "sha256")
        .withColumn("is_duplicate", ~same)
        .withColumn("duplicate_of", F.when(~same, F.col("_first")))
        .drop("_first")
    )


def inventory_counts(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("is_duplicate")).alias("unique"),
        F.count_if(F.col("is_duplicate")).alias("duplicates"),
    )


def register_sources(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Outcome per incoming row: new, resumed, duplicate or conflict.

    incoming: run_id, sha256, ordinal (input order), ...; existing: sha256, run_id,
    status (unique on sha256). The first row that may take the hash over (unknown, or
    failed in the same run) becomes its owner; rows after it meet that new state and
    all others meet the stored one. Every step is keyed by sha256: one shuffle.
    """
    stored = existing.select(
        "sha256", F.col("run_id").alias("_run"), F.col("status").alias("_status")
    )
    df = incoming.join(stored, "sha256", "left")
    takes_over = F.col("_status").isNull() | (
        (F.col("_status") == "failed") & (F.col("_run") == F.col("run_id"))
    )
    lead = df.filter(takes_over).groupBy("sha256").agg(
        F.min(F.struct("ordinal", "run_id")).alias("_lead")
    )

    def against(run: Column, status: Column) -> Column:
        mine = run == F.col("run_id")
        return (
            F.when(status == "completed", "duplicate")
            .when(mine & status.isin("pending", "processing"), "duplicate")
            .when(~mine, "conflict")
            .otherwise("resumed")
        )

    after_lead = F.coalesce(F.col("ordinal") > F.col("_lead.ordinal"), F.lit(False))
    outcome = (
        F.when(F.col("ordinal") == F.col("_lead.ordinal"),
               F.when(F.col("_status").isNull(), "new").otherwise("resumed"))
        .when(after_lead, against(F.col("_lead.run_id"), F.lit("processing")))
        .otherwise(against(F.col("_run"), F.col("_status")))
    )
    met = F.when(after_lead, F.lit("processing")).otherwise(F.col("_status"))
    return (
        df.join(lead, "sha256", "left")
        .withColumn("outcome", outcome)
        .withColumn("source_id", source_id(F.col("sha256")))
        .withColumn("status", F.when(F.col("outcome").isin("new", "resumed"), "processing")
                    .when(F.col("outcome") == "duplicate", met))
        .drop("_lead", "_run", "_status")
    )


def upload_checks(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Name, suffix, size, pixel and case-folded uniqueness rules per uploaded file."""
    folded = batch.withColumn("_fold", F.lower("name"))
    repeats = folded.groupBy("batch_id", "_fold").agg(F.count(F.lit(1)).alias("_n"))
    taken = existing.select(F.lower("name").alias("_fold"), F.lit(True).alias("_taken")).distinct()
    return (
        folded.join(repeats, ["batch_id", "_fold"]).join(taken, "_fold", "left")
        .withColumn("violations", upload_codes(
            F.col("name"), F.col("size_bytes"), F.col("pixels"),
            F.col("_n") > 1, F.coalesce("_taken", F.lit(False)),
        ))
        .withColumn("accepted", F.size("violations") == 0)
        .drop("_fold", "_n", "_taken")
    )
