"""Candidate geometry, filtering, suppression and caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightledger.catalog.registry import query
from sightledger.functions import masks
from sightledger.functions.vectors import select_patches
from sightledger.operators import candidates as ops
from sightledger.params import Params
from sightledger.plans.views import CANVAS

P = Params()

BOXES = """
boxes AS (
  SELECT 'img_' || (l_orderkey // 16) AS source_id,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT || '-' || strftime(l_shipdate, '%Y%m%d') AS raw_candidate_id,
         0.8::DOUBLE + l_discount * 2 AS score,
         (l_partkey % 90)::INT AS x0, (l_suppkey % 80)::INT AS y0,
         (l_partkey % 90)::INT + 1 + l_quantity::INT % 40 AS x1,
         (l_suppkey % 80)::INT + 1 + l_quantity::INT % 30 AS y1
  FROM lineitem),
clipped AS (
  SELECT *, least(x1, 100) AS cx1, least(y1, 100) AS cy1,
         'prop_' || substr(sha256(source_id || chr(10) || raw_candidate_id), 1, 32) AS id
  FROM boxes),
prep AS (
  SELECT *, (cx1 - x0) * (cy1 - y0) AS area,
         ((cx1 - x0) * (cy1 - y0)) / 10000.0::DOUBLE AS ratio FROM clipped),
judged AS (
  SELECT *, CASE WHEN score < 0.88::DOUBLE THEN 'low_confidence'
                 WHEN area = 0 THEN 'empty_mask'
                 WHEN ratio < 0.0005::DOUBLE THEN 'mask_too_small'
                 WHEN ratio > 0.5::DOUBLE THEN 'mask_too_large' END AS early
  FROM prep)
"""

SCAN = BOXES + """,
surv AS (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, raw_candidate_id) AS rn
  FROM judged WHERE early IS NULL),
scan AS (
  SELECT DISTINCT source_id, 0::BIGINT AS rn, NULL::VARCHAR AS id, NULL::VARCHAR AS dup, NULL::VARCHAR AS con,
         []::STRUCT(id VARCHAR, x0 INT, y0 INT, x1 INT, y1 INT, area INT)[] AS kept
  FROM surv
  UNION ALL
  SELECT source_id, rn, id, dup, con,
         CASE WHEN dup IS NULL AND con IS NULL THEN list_append(kept, me) ELSE kept END
  FROM (
    SELECT s.source_id, s.rn, s.id, c.kept,
           {'id': s.id, 'x0': s.x0, 'y0': s.y0, 'x1': s.cx1, 'y1': s.cy1, 'area': s.area}
             ::STRUCT(id VARCHAR, x0 INT, y0 INT, x1 INT, y1 INT, area INT) AS me,
           list_filter(list_transform(c.kept, lambda k: {'id': k.id, 'area': k.area,
             'i': greatest(0, least(s.cx1, k.x1) - greatest(s.x0, k.x0))
                * greatest(0, least(s.cy1, k.y1) - greatest(s.y0, k.y0))}),
             lambda k: k.i / (s.area + k.area - k.i)::DOUBLE >= 0.9::DOUBLE)[1].id AS dup,
           list_filter(list_transform(c.kept, lambda k: {'id': k.id, 'area': k.area,
             'i': greatest(0, least(s.cx1, k.x1) - greatest(s.x0, k.x0))
                * greatest(0, least(s.cy1, k.y1) - greatest(s.y0, k.y0))}),
             lambda k: s.area < k.area AND k.i / s.area::DOUBLE >= 0.9::DOUBLE)[1].id AS con
    FROM scan c JOIN surv s ON s.source_id = c.source_id AND s.rn = c.rn + 1)),
solved AS (
  SELECT source_id, id, CASE WHEN dup IS NOT NULL THEN 'duplicate_mask:' || dup
                             WHEN con IS NOT NULL THEN 'contained_mask:' || con END AS overlap,
         count(*) FILTER (WHERE dup IS NULL AND con IS NULL)
           OVER (PARTITION BY source_id ORDER BY rn) AS krank
  FROM scan WHERE id IS NOT NULL),
outcome AS (
  SELECT j.source_id, j.raw_candidate_id, j.id, j.area,
         coalesce(j.early, s.overlap, CASE WHEN s.krank > 24 THEN 'candidate_limit' END) AS filter_reason,
         s.krank
  FROM judged j LEFT JOIN solved s USING (source_id, id))
"""


@query("point_grid", """
WITH img AS (SELECT p_partkey, 100 + p_size AS w, 60 + p_size * 2 AS h FROM part),
g AS (SELECT *, unnest(generate_series(0, 15)) AS i FROM img)
SELECT p_partkey, i AS point_index, (i % 4 + 0.5::DOUBLE) * (w / 4.0::DOUBLE) AS x,
       (i // 4 + 0.5::DOUBLE) * (h / 4.0::DOUBLE) AS y, printf('grid_point_%06d', i) AS raw_candidate_id
FROM g""")
def point_grid(v):
    images = v.table("part").select(
        "p_partkey", (F.col("p_size") + 100).alias("image_w"), (F.col("p_size") * 2 + 60).alias("image_h"))
    return masks.point_grid(images, 4).drop("image_w", "image_h")


@query("best_mask_per_point", """
WITH m AS (
  SELECT 'img_' || (l_orderkey % 500) AS source_id, l_partkey AS point_index,
         row_number() OVER (PARTITION BY l_orderkey % 500, l_partkey
                            ORDER BY l_orderkey, l_linenumber, l_suppkey) - 1 AS mask_index,
         l_discount * 12 AS score FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id, point_index ORDER BY score DESC, mask_index) AS rn FROM m)
SELECT source_id, point_index, printf('grid_point_%06d', point_index) AS raw_candidate_id,
       'automatic_point_grid' AS prompt, mask_index, least(greatest(score, 0), 1)::DOUBLE + 0.0 AS score
FROM r WHERE rn = 1""")
def best_mask_per_point(v):
    from pyspark.sql import Window as W
    w = W.partitionBy((F.col("l_orderkey") % 500), "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey")
    m = v.table("lineitem").select(
        F.concat(F.lit("img_"), (F.col("l_orderkey") % 500).cast("string")).alias("source_id"),
        F.col("l_partkey").alias("point_index"),
        (F.row_number().over(w) - 1).cast("long").alias("mask_index"),
        (F.col("l_discount") * 12).alias("score"), F.lit(None).cast("string").alias("runs"))
    return ops.best_mask_per_point(m).drop("runs").withColumn("score", F.col("score") + 0.0)


@query("mask_geometry", f"""
WITH {BOXES}
SELECT source_id, raw_candidate_id, id, area AS mask_area_pixels, ratio AS mask_area_ratio,
       x0::DOUBLE AS x_min, y0::DOUBLE AS y_min, cx1::DOUBLE AS x_max, cy1::DOUBLE AS y_max,
       greatest(0, x0 - 8) AS crop_left, greatest(0, y0 - 8) AS crop_top,
       least(100, cx1 + 8) AS crop_right, least(100, cy1 + 8) AS crop_bottom
FROM prep""")
def mask_geometry(v):
    c = ops.prepare(v.candidates(), P).withColumn("m", masks.mask_bbox("runs", CANVAS))
    c = c.withColumn("c", masks.crop_box("bbox", "image_w", "image_h", P.crop_padding))
    return c.select(
        "source_id", "raw_candidate_id", "id", "mask_area_pixels", "mask_area_ratio", "m.*",
        *[F.col(f"c.{s}").alias(f"crop_{s}") for s in ("left", "top", "right", "bottom")])


@query("candidate_filter", f"""
WITH {BOXES}
SELECT source_id, id, early AS reason, x0::DOUBLE AS x_min, cx1::DOUBLE AS x_max,
       y0::DOUBLE AS y_min, cy1::DOUBLE AS y_max FROM judged""")
def candidate_filter(v):
    return ops.prepare(v.candidates(), P).select("source_id", "id", F.col("early_reason").alias("reason"), "bbox.*")


@query("mask_overlaps", f"""
WITH {BOXES},
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, x0, y0, cx1, cy1 ORDER BY score DESC, raw_candidate_id) AS cp
      FROM prep WHERE score >= 0.88::DOUBLE) WHERE cp = 1),
pairs AS (
  SELECT a.source_id, a.id AS first_id, b.id AS second_id, a.area AS first_area, b.area AS second_area,
         greatest(0, least(a.cx1, b.cx1) - greatest(a.x0, b.x0))
         * greatest(0, least(a.cy1, b.cy1) - greatest(a.y0, b.y0)) AS intersection
  FROM s a JOIN s b ON a.source_id = b.source_id
   AND (a.score > b.score OR (a.score = b.score AND a.raw_candidate_id < b.raw_candidate_id)))
SELECT source_id, first_id, second_id, first_area, second_area, intersection,
       round(intersection / (first_area + second_area - intersection)::DOUBLE, 9) AS iou,
       round(intersection / second_area::DOUBLE, 9) AS second_in_first,
       round(intersection / first_area::DOUBLE, 9) AS first_in_second
FROM pairs WHERE intersection > 0""")
def mask_overlaps(v):
    c = v.candidates().filter(F.col("score") >= P.confidence_threshold)
    out = ops.class_overlaps(ops.prepare(c, P), P, rows_of=c)
    return out.select(*out.columns[:6], *[F.round(c, 9).alias(c) for c in out.columns[6:]])


@query("select_patches", f"""
WITH {BOXES},
cells AS (SELECT id, x0, y0, cx1, cy1, r, c FROM clipped,
          (SELECT unnest(generate_series(0, 4)) AS r), (SELECT unnest(generate_series(0, 4)) AS c))
SELECT id, r, c FROM cells
WHERE greatest(0, least(cx1, (c + 1) * 20) - greatest(x0, c * 20))
    * greatest(0, least(cy1, (r + 1) * 20) - greatest(y0, r * 20)) / 400.0::DOUBLE >= 0.5::DOUBLE""")
def patches(v):
    c = v.candidates().withColumn("id", masks_id())
    picked = select_patches(F.col("runs"), CANVAS, CANVAS, 5, P.min_patch_coverage)
    return c.select("id", F.explode(picked).alias("p")).select("id", "p.*")


def masks_id():
    from sightledger.functions.identity import proposal_id
    return proposal_id(F.col("source_id"), F.col("raw_candidate_id"))


@query("suppress_overlaps", f"""
WITH RECURSIVE {SCAN}
SELECT source_id, id, overlap AS filter_reason, CASE WHEN overlap IS NULL THEN krank END AS kept_rank
FROM solved""")
def suppress_overlaps(v):
    c = v.candidates()
    ready = ops.prepare(c, P).filter(F.col("early_reason").isNull())
    return ops.suppress_overlaps(ready, P, rows_of=c)


@query("process_candidates", f"""
WITH RECURSIVE {SCAN}
SELECT source_id, raw_candidate_id, id, area AS mask_area_pixels, filter_reason,
       CASE WHEN filter_reason IS NULL THEN krank END AS kept_rank,
       CASE WHEN filter_reason IS NULL THEN 'pending' ELSE 'filtered' END AS status
FROM outcome""")
def process_candidates(v):
    return ops.process_candidates(v.candidates(), P).select(
        "source_id", "raw_candidate_id", "id", "mask_area_pixels", "filter_reason", "kept_rank", "status")


@query("filter_counts", f"""
WITH RECURSIVE {SCAN}
SELECT source_id, split_part(filter_reason, ':', 1) AS reason, count(*) AS n
FROM outcome WHERE filter_reason IS NOT NULL GROUP BY ALL""")
def filter_counts(v):
    return ops.filter_counts(ops.outcomes(v.candidates(), P, ["source_id"]))


@query("candidate_cap", f"""
WITH {BOXES},
r AS (SELECT source_id, raw_candidate_id, score,
             row_number() OVER (PARTITION BY source_id ORDER BY score DESC, raw_candidate_id) AS rn FROM boxes)
SELECT source_id, raw_candidate_id, round(score, 6) AS score, CASE WHEN rn <= 24 THEN rn END AS kept_rank,
       CASE WHEN rn > 24 THEN 'candidate_limit' END AS filter_reason FROM r""")
def candidate_cap(v):
    boxes = v.boxes().select("source_id", "raw_candidate_id", "score")
    return ops.candidate_cap(boxes, P.max_candidates_per_image).withColumn("score", F.round("score", 6))


@query("reason_kind", """
WITH r AS (
  SELECT CASE WHEN l_linenumber % 4 = 0 THEN 'low_confidence'
              WHEN l_linenumber % 4 = 1 THEN 'duplicate_mask:prop'
              WHEN l_linenumber % 4 = 2 THEN 'qwen_cluster_ignore:background: wall'
              ELSE 'candidate_limit' END AS reason FROM lineitem WHERE l_returnflag = 'R')
SELECT split_part(reason, ':', 1) AS kind,
       CASE split_part(reason, ':', 1) WHEN 'low_confidence' THEN '质量分不足'
            WHEN 'duplicate_mask' THEN '重复mask' WHEN 'candidate_limit' THEN '超过每图保留上限'
            ELSE split_part(reason, ':', 1) END AS label, count(*) AS n
FROM r GROUP BY ALL""")
def reason_kind(v):
    df = v.proposals().filter(F.col("filter_reason").isNotNull())
    return df.groupBy(masks.reason_kind(F.col("filter_reason")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("label", masks.reason_label(F.col("kind")))
