"""Point grids, masks as row runs, boxes and the filter ladder (all JVM side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightledger.params import Params
from sightledger.schema import FILTER_REASON_LABELS


def point_grid(images: DataFrame, per_side: int) -> DataFrame:
    """per_side x per_side cell centres per image, row-major, with grid ids."""
    n = F.lit(per_side)
    step_x, step_y = F.col("image_w") / n, F.col("image_h") / n
    return (
        images.withColumn("point_index", F.explode(F.sequence(F.lit(0), n * n - 1)))
        .withColumn("x", (F.col("point_index") % n + 0.5) * step_x)
        .withColumn("y", (F.floor(F.col("point_index") / n) + 0.5) * step_y)
        .withColumn("raw_candidate_id", grid_point_id(F.col("point_index")))
    )


def grid_point_id(index: Column) -> Column:
    return F.format_string("grid_point_%06d", index)


def rect_runs(x0: Column, y0: Column, x1: Column, y1: Column, width, height) -> Column:
    """Row runs of a filled rectangle, clipped to the canvas."""
    left, right = F.greatest(x0, F.lit(0)), F.least(x1, F.lit(width))
    top, bottom = F.greatest(y0, F.lit(0)), F.least(y1, F.lit(height))
    at = lambda y: y.cast("long") * width + left
    # Whole arrays in generated code, no function per row.
    starts = F.sequence(at(top), at(bottom - 1), F.lit(width).cast("long"))
    rows = F.arrays_zip(starts, F.array_repeat((right - left).cast("int"), bottom - top)).cast(
        "array<struct<start:bigint,len:int>>")
    return F.when((right > left) & (bottom > top), rows).otherwise(
        F.expr("cast(array() as array<struct<start:bigint,len:int>>)")
    )


def mask_area(runs) -> Column:
    runs = F.col(runs) if isinstance(runs, str) else runs
    return F.aggregate(runs["len"], F.lit(0).cast("long"), lambda acc, n: acc + n)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where a filter inlines the column."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mask_bbox(runs, width) -> Column:
    """(min x, min y, max x + 1, max y + 1); null for an empty mask."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    width = F.col(width) if isinstance(width, str) else F.lit(width)
    x0 = lambda r: r["start"] % width
    y = lambda r: F.floor(r["start"] / width)
    box = F.struct(
        F.array_min(F.transform(runs, x0)).cast("double").alias("x_min"),
        F.array_min(F.transform(runs, y)).cast("double").alias("y_min"),
        F.array_max(F.transform(runs, lambda r: x0(r) + r["len"])).cast("double").alias("x_max"),
        (F.array_max(F.transform(runs, y)) + 1).cast("double").alias("y_max"),
    )
    return F.when(F.size(runs) > 0, box)


def clamp_bbox(box, width, height) -> Column:
    """Clamp to the image; null when nothing of positive size is left."""
    b = F.col(box) if isinstance(box, str) else box
    w, h = F.col(width).cast("double"), F.col(height).cast("double")
    zero = F.lit(0.0)
    clamped = F.struct(
        F.greatest(zero, F.least(w, b["x_min"])).alias("x_min"),
        F.greatest(zero, F.least(h, b["y_min"])).alias("y_min"),
        F.greatest(zero, F.least(w, b["x_max"])).alias("x_max"),
        F.greatest(zero, F.least(h, b["y_max"])).alias("y_max"),
    )
    ok = (clamped["x_max"] > clamped["x_min"]) & (clamped["y_max"] > clamped["y_min"])
    return F.when(ok, clamped)


def stored_bbox(clamped: Column, width, height) -> Column:
    one = F.lit(1.0)
    fallback = F.struct(
        F.lit(0.0).alias("x_min"), F.lit(0.0).alias("y_min"),
        F.least(F.col(width).cast("double"), one).alias("x_max"),
        F.least(F.col(height).cast("double"), one).alias("y_max"),
    )
    return F.coalesce(clamped, fallback)


def crop_box(box, width, height, padding: int) -> Column:
    b = F.col(box) if isinstance(box, str) else box
    return F.struct(
        F.greatest(F.lit(0), F.floor(b["x_min"]) - padding).cast("int").alias("left"),
        F.greatest(F.lit(0), F.floor(b["y_min"]) - padding).cast("int").alias("top"),
        F.least(F.col(width), F.ceil(b["x_max"]) + padding).cast("int").alias("right"),
        F.least(F.col(height), F.ceil(b["y_max"]) + padding).cast("int").alias("bottom"),
    )


def filter_reason(
    score: Column, shape_ok: Column, area: Column, image_area: Column, box: Column, p: Params
) -> Column:
    """First failing rule in the fixed order; null when the candidate survives.

    A candidate without a score, or of unknown shape, never survives.
    """
    def by_area(a):
        return (
            F.when(a == 0, "empty_mask")
            .when(a / image_area < p.min_mask_area_ratio, "mask_too_small")
            .when(a / image_area > p.max_mask_area_ratio, "mask_too_large")
            .when(box.isNull(), "invalid_bbox")
        )

    return (
        F.when(score.isNull(), "missing_score")
        .when(score < p.confidence_threshold, "low_confidence")
        .when(~F.coalesce(shape_ok, F.lit(False)), "mask_shape_mismatch")
        .otherwise(let(area, by_area))
    )


def iou(inter: Column, area_a: Column, area_b: Column) -> Column:
    union = area_a + area_b - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def containment(inter: Column, inner_area: Column) -> Column:
    return F.when(inner_area > 0, inter / inner_area).otherwise(F.lit(0.0))


def reason_kind(reason: Column) -> Column:
    """Strip the id or message suffix: ``duplicate_mask:prop_x`` -> ``duplicate_mask``."""
    return F.split_part(reason, F.lit(":"), F.lit(1))


def reason_label(kind: Column) -> Column:
    """Display label of a reason kind; an unknown kind shows itself."""
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in FILTER_REASON_LABELS.items()], kind)
