"""All tunable settings of a resolution run in one frozen dataclass."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Params:
    """Defaults are fixed values of the data model; see SURVEY section 1.4."""

    points_per_side: int = 16
    points_per_batch: int = 32
    confidence_threshold: float = 0.88
    min_mask_area_ratio: float = 0.0005
    max_mask_area_ratio: float = 0.5
    duplicate_iou: float = 0.9
    containment: float = 0.9
    max_candidates_per_image: int = 24
    crop_padding: int = 8
    max_clusters_per_batch: int = 8
    min_patch_coverage: float = 0.5
    local_patch_similarity: float = 0.7
    global_weight: float = 0.5
    local_weight: float = 0.5
    match_threshold: float = 0.75
    ambiguity_margin: float = 0.05
    local_top_k: int = 3
    cluster_similarity: float = 0.75
    max_representatives: int = 4

    # Physical bounds: rows one task or one Arrow group may hold. They never
    # change a result, only how the same work is cut into tasks.
    tile_rows: int = 8192
    profile_rows: int = 2048
    greedy_rows: int = 4096
    component_rows: int = 200_000

    def __post_init__(self) -> None:
        unit = (
            "confidence_threshold", "min_mask_area_ratio", "global_weight",
            "local_weight",
        )
        unit_open = (
            "max_mask_area_ratio", "duplicate_iou", "containment",
            "min_patch_coverage",
        )
        cosine = ("local_patch_similarity", "match_threshold", "cluster_similarity")
        for name in unit:
            self._between(name, 0.0, 1.0)
        for name in unit_open:
            self._between(name, 0.0, 1.0)
            if getattr(self, name) == 0.0:
                raise ValueError(f"{name} must be greater than 0")
        for name in cosine:
            self._between(name, -1.0, 1.0)
        self._between("points_per_side", 2, 64)
        self._between("points_per_batch", 1, 256)
        self._between("max_candidates_per_image", 1, 256)
        self._between("max_clusters_per_batch", 1, None)
        self._between("ambiguity_margin", 0.0, 2.0)
        self._between("local_top_k", 1, 64)
        self._between("max_representatives", 1, 8)
        self._between("crop_padding", 0, None)
        for name in ("tile_rows", "profile_rows", "greedy_rows", "component_rows"):
            self._between(name, 1, None)
        if self.min_mask_area_ratio >= self.max_mask_area_ratio:
            raise ValueError("min_mask_area_ratio must be below max_mask_area_ratio")
        if abs(self.global_weight + self.local_weight - 1.0) > 1e-9:
            raise ValueError("global_weight and local_weight must sum to 1")

    def _between(self, name, low, high) -> None:
        value = getattr(self, name)
        if value < low or (high is not None and value > high):
            raise ValueError(f"{name}={value} is outside [{low}, {high}]")

    @classmethod
    def from_mapping(cls, values: dict) -> "Params":
        """Build from a mapping; unknown names are an error, as in a strict config."""
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(values) - known)
        if unknown:
            raise ValueError(f"unknown settings: {unknown}")
        return cls(**values)
