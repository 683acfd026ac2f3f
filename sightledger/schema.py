"""Fixed schemas and enumerations of the ledger tables (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 3
LEGACY_SCHEMA_VERSION = 2

# --- fixed values: enumerations of the data model -------------------------
RUN_STATUS = ("running", "completed", "completed_with_errors", "failed")
SOURCE_STATUS = ("pending", "processing", "completed", "failed")
PROPOSAL_STATUS = ("pending", "filtered", "decided", "failed")
OBJECT_STATUS = ("active", "archived")
DECISION = ("new", "existing", "uncertain")
REASON_CODE = (
    "new_object", "visual_instance_match", "cluster_member", "ambiguous_match",
    "insufficient_evidence",
)
HYPOTHESIS = ("new", "existing", "uncertain")
VERDICT = ("object", "ignore", "uncertain")
MATCH_RESULT = ("match", "no_match", "ambiguous")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
IMAGE_COLLECTIONS = ("sources", "proposals", "clusters", "objects")
AUDIT_COLLECTIONS = ("raw_responses", "run_reports")
STAGE_BOUNDS = {
    "input_registration": (0.0, 10.0),
    "sam3": (10.0, 40.0),
    "dinov3": (40.0, 70.0),
    "clustering": (70.0, 75.0),
    "cluster_review": (75.0, 95.0),
    "report": (95.0, 100.0),
}
TERMINAL_STAGE_STATUS = ("completed", "completed_with_errors", "failed", "skipped")
FILTER_REASON_LABELS = {
    "low_confidence": "质量分不足",
    "mask_too_small": "区域过小",
    "mask_too_large": "覆盖范围过大",
    "duplicate_mask": "重复mask",
    "contained_mask": "被更完整区域包含",
    "candidate_limit": "超过每图保留上限",
    "empty_mask": "空mask",
    "mask_shape_mismatch": "mask尺寸异常",
    "invalid_bbox": "定位框异常",
}
CANDIDATE_SOURCE = "automatic_point_grid"
IGNORE_REASON_PREFIX = "qwen_cluster_ignore"
LEGACY_WHOLE_PART = "整体（旧版）"
CLUSTER_MEMBER_REASON = "该视角与本批次首个新对象候选属于同一DINOv3聚类。"
IDENTITY_REASONS = {
    "reviewer_uncertain": "Qwen无法确认该视觉聚类是否为一个完整且一致的物体。",
    "ambiguous": "聚类对历史对象的第一、第二视觉匹配不足以安全区分。",
    "new": "Qwen确认其为完整对象，且DINOv3未匹配已有对象。",
    "new_but_matched": "Qwen判断为新对象，但DINOv3聚类证据匹配已有对象。",
    "existing": "Qwen对象判断与DINOv3历史视角匹配一致。",
    "existing_unsupported": "Qwen已有对象判断未得到同一DINOv3对象匹配支持。",
}
TERMINAL_MESSAGES = {
    "completed": "Experiment completed.",
    "unexpected": "Experiment process disappeared after service recovery; inspect process_error.log_tail.",
    "failed": "Experiment finished with a failed result; inspect the report and audit trail.",
}
SOURCE_FAILURES = {
    "pending": "Source contains proposals without a terminal cluster result",
    "failed": "Source contains failed cluster proposals",
}
CHECKS = (
    "input_images_nonempty", "every_input_accounted_for", "automatic_candidate_source_recorded",
    "every_kept_proposal_has_fingerprint_or_failure", "every_candidate_has_terminal_status",
    "every_cluster_has_qwen_result_or_failure", "no_source_left_processing", "no_pending_proposals",
)
LIBRARY_DIRECTORIES = ("sources", "proposals", "objects", "raw_responses", "run_reports")
# ---------------------------------------------------------------------------

BBOX = T.StructType([
    T.StructField(c, T.DoubleType()) for c in ("x_min", "y_min", "x_max", "y_max")
])
RUNS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("len", T.IntegerType()),
]))
PART = T.StructType([
    T.StructField("part", T.StringType()),
    T.StructField("color", T.ArrayType(T.StringType())),
    T.StructField("material", T.ArrayType(T.StringType())),
])
SUMMARY = T.StructType([
    T.StructField("object_name_zh", T.StringType()),
    T.StructField("coarse_category", T.StringType()),
    T.StructField("fine_category", T.StringType()),
    T.StructField("stable_description", T.StringType()),
    T.StructField("stable_identity_features", T.ArrayType(T.StringType())),
    T.StructField("brand_or_markings", T.ArrayType(T.StringType())),
    T.StructField("part_appearance", T.ArrayType(PART)),
    T.StructField("summary_confidence", T.DoubleType()),
])
REVIEW = T.StructType([
    T.StructField("cluster_id", T.StringType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("identity_hypothesis", T.StringType()),
    T.StructField("matched_object_id", T.StringType()),
    T.StructField("short_reason", T.StringType()),
    T.StructField("object_summary", SUMMARY),
])
OBJECT_SCORE = T.StructType([
    T.StructField("object_id", T.StringType()),
    T.StructField("observation_id", T.StringType()),
    T.StructField("global_similarity", T.DoubleType()),
    T.StructField("local_match_ratio", T.DoubleType()),
    T.StructField("visual_score", T.DoubleType()),
])
EVENT = T.StructType([
    T.StructField("sequence", T.LongType()),
    T.StructField("timestamp_utc", T.TimestampType()),
    T.StructField("elapsed_seconds", T.DoubleType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("current", T.IntegerType()),
    T.StructField("total", T.IntegerType()),
    T.StructField("overall_percent", T.DoubleType()),
    T.StructField("message", T.StringType()),
    T.StructField("data", T.StringType()),
])

RUN_TABLE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
    T.StructField("config_digest", T.StringType()),
    T.StructField("segmenter_model_id", T.StringType()),
    T.StructField("reviewer_model_id", T.StringType()),
    T.StructField("embedder_model_id", T.StringType()),
    T.StructField("error_message", T.StringType()),
])
SOURCE_TABLE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("run_id", T.StringType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("relative_path", T.StringType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
PROPOSAL_TABLE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("source_id", T.StringType()),
    T.StructField("raw_candidate_id", T.StringType()),
    T.StructField("prompt", T.StringType()), T.StructField("target_id", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("bbox", BBOX),
    T.StructField("mask_area_pixels", T.LongType()),
    T.StructField("mask_area_ratio", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("filter_reason", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
OBJECT_TABLE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("version", T.LongType()),
    T.StructField("summary", SUMMARY), T.StructField("status", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
OBSERVATION_TABLE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("object_id", T.StringType()),
    T.StructField("proposal_id", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
DECISION_TABLE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("proposal_id", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("matched_object_id", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reason_code", T.StringType()),
    T.StructField("short_reason", T.StringType()),
    T.StructField("hypothesis", T.StringType()),
    T.StructField("hypothesis_object_id", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
])
LEDGER = {
    "runs": RUN_TABLE, "source_images": SOURCE_TABLE, "proposals": PROPOSAL_TABLE,
    "objects": OBJECT_TABLE, "observations": OBSERVATION_TABLE,
    "decisions": DECISION_TABLE,
}
