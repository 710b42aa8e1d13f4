"""What of an image is masked: moving objects, and surfaces without a place of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of objects that move, and labels of water and sky.
MOVING = ("person", "bicycle", "car", "motorcycle", "bus", "truck", "train", "boat", "bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe")
UNSTEADY = ("water", "sea", "river", "lake", "swimming pool", "sky")


def masks(detections: DataFrame, frame: str = "frame_index", threshold: float = 0.5) -> DataFrame:
    """frame, n_detections and masked_share from one row per detection and pixel (detection_id, class, row, col, share, height, width).

    Only classes of MOVING and UNSTEADY mask, where the resized mask's share
    exceeds the threshold; a pixel that several mask counts once. Detections
    count if they are of a moving class, whatever they cover.
    """
    label = F.lower("class")
    kept = detections.where(label.isin(*MOVING, *UNSTEADY))
    seen = kept.where(label.isin(*MOVING)).groupBy(frame).agg(F.countDistinct("detection_id").alias("n_detections"))
    pixel = kept.where(F.col("share") > threshold).groupBy(frame, "row", "col").agg(F.first(F.col("height") * F.col("width")).alias("_all"))
    share = pixel.groupBy(frame).agg((F.count(F.lit(1)) / F.first("_all")).alias("masked_share"))
    both = detections.select(frame).distinct().join(seen, frame, "left").join(share, frame, "left")
    return both.select(frame, F.coalesce("n_detections", F.lit(0)).cast("bigint").alias("n_detections"), F.coalesce("masked_share", F.lit(0.0)).alias("masked_share"))
