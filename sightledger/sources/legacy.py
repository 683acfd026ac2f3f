"""Objects of the legacy (version 2) layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightledger.schema import LEGACY_WHOLE_PART


def json_list(text: Column) -> Column:
    """List of strings; anything that is not a JSON list gives an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def read_legacy_objects(rows: DataFrame) -> DataFrame:
    """rows: id, status, material_json, color_json, description, annotation_confidence."""
    df = rows.withColumn("material", json_list(F.col("material_json"))).withColumn(
        "color", json_list(F.col("color_json")))
    part = F.array(F.struct(F.lit(LEGACY_WHOLE_PART).alias("part"), "color", "material"))
    any_look = (F.size("material") > 0) | (F.size("color") > 0)
    empty = F.array().cast("array<string>")
    return df.select(
        "id", "status", "material", "color",
        F.col("description").alias("stable_description"),
        empty.alias("stable_identity_features"), empty.alias("brand_or_markings"),
        F.when(any_look, part).otherwise(F.filter(part, lambda x: F.lit(False))).alias("part_appearance"),
        F.col("annotation_confidence").alias("summary_confidence"),
    )
