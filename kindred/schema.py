"""Explicit schemas, enum domains and uniqueness assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The enum domains.
RUN_STATUS = ("pending", "preflight", "indexing", "matching", "scoring", "resolving", "review_pending", "analysis_complete", "action_in_progress", "action_complete", "completed_with_errors", "paused", "canceled", "failed")
SCAN_STATUS = ("pending", "scanning", "decoded", "hash_computed", "phash_computed", "completed", "decode_failed", "hash_failed", "phash_failed", "error")
ANALYSIS = ("exact_duplicate", "likely_compressed", "variant", "similar_keep", "no_baseline_match", "inconclusive", "not_evaluated", "error")
REVIEW = ("not_required", "pending", "approved_for_recycle", "rejected_keep")
ACTIONS = ("none", "validating", "prepared", "recycled", "restored", "permanently_deleted", "stale", "failed", "reconciliation_required")
OPERATIONS_LOGGED = ("validating", "prepared", "recycled", "restored", "permanently_deleted", "validation_failed", "operation_failed", "stale", "reconciliation_required")
ROLES = ("baseline", "comparison")
RELATIONS = ("exact", "compressed_or_reencoded", "variant", "related_group", "weak_candidate")
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "gif")
EXCLUDES = (".recycle", ".git", "node_modules")


def _schema(text: str) -> T.StructType:
    out = T.StructType()
    for part in text.split(","):
        name, kind = part.split()
        out.add(name, {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "bool": T.BooleanType(), "longs": T.ArrayType(T.LongType())}[kind.rstrip("!")], not kind.endswith("!"))
    return out


IMAGES = _schema("id long!, run_id string!, folder_id long!, source_role string!, file_path string!, relative_path string!, file_size long!, file_modified_at long!, width int!, height int!, format string!, color_type string, aspect_ratio double!, digest string, phash string, scan_status string!, error_message string, scanned_at long!")
RESULTS = _schema("id long!, run_id string!, comparison_image_id long!, analysis_type string!, primary_match_image_id long, all_candidate_ids longs, candidate_truncated bool!, phash_distance int, ssim_score double, size_ratio double, resolution_ratio double, aspect_diff double, direction_smaller_resolution bool!, direction_smaller_filesize bool!, algorithm_profile_id string!, analysis_metadata string, computed_at long!")
OPERATIONS = _schema("id long!, run_id string!, analysis_result_id long!, operation_type string!, source_path string!, target_path string, error_message string, created_at long!")
#: Setting, its kind and the value that stands in for a missing or unreadable one.
SETTINGS = {"default_compressed_ssim_threshold": ("double", 0.995), "default_variant_review_lower_bound": ("double", 0.75), "default_phash_max_distance": ("int", 10), "default_aspect_ratio_tolerance": ("double", 0.005), "auto_preselect_exact_duplicates": ("string", "0"), "max_candidate_per_image": ("int", 50)}
UNIQUE = {"images": ("run_id", "file_path"), "analysis_results": ("run_id", "comparison_image_id"), "folders": ("run_id", "path")}


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` if no two rows share ``keys``; raises otherwise."""
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{', '.join(keys)} is not unique")
    return df


def assert_domain(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """``df`` if ``column`` has only values of the domain; raises otherwise."""
    if df.filter(~F.col(column).isin(*values)).limit(1).count():
        raise ValueError(f"{column} has a value outside its domain")
    return df
