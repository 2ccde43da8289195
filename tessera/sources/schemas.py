"""Schemas of the tables, and checks of what comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import is_valid

OBSERVATIONS = "camera string, track_id bigint, segment int, tracklet_key string, frame bigint, ts double, x1 int, y1 int, x2 int, y2 int, detection_score double, quality double, run_id string"
FEATURES = "tracklet_key string, model string, view string, seq bigint, ts double, quality double, vec array<float>"
POINTS = "point_id string, run_id string, camera string, track_id bigint, frame bigint, ts double, vec array<float>, global_id bigint, reid_id bigint"
DETECTIONS = (
    "camera string, frame bigint, timestamp double, track_id bigint, segment int, tracklet_key string, bbox array<int>, detection_score double, overlap_blocked boolean, overlap_partners array<string>, overlap_boundary boolean, "
    "segment_reason string, recovery_after_overlap boolean, position_tracked_every_frame boolean, post_overlap_feature_check boolean, post_overlap_reid_scores map<string,double>, post_overlap_reid_fused double, post_overlap_model_support int, post_overlap_same_pre_identity boolean"
)
LABELS = "run_id string, a string, b string, verdict string, source string, stated boolean, quote string"
TRACKLET_PAIRS = "run_id string, a array<string>, b array<string>, lane string, same boolean, person string, note string, source string"
CALIBRATION = "camera string, floor_group string, homography array<double>, width int, height int, position_error double"
TOPOLOGY = "a string, b string, seconds double"
DECISIONS = "handle string, phase string, round int, gates map<string,struct<value:double,threshold:double,passed:boolean>>, candidates array<struct<handle:string,score:double,excluded_by:string,cameras:array<string>,observations:int>>"


def valid_vectors(df: DataFrame, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows with vectors of ``dim`` finite numbers, not all 0, and the others."""
    good = is_valid(F.col(vector), dim)
    return df.where(good), df.where(~good)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, with how often: a source that must be unique has none."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
