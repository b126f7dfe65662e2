"""Summaries of detections. detections: image_id, idx, prompt, confidence, x1..y2, mask_pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import filter_confidence


def detected_masks(detections: DataFrame, mask_runs: DataFrame, confidence_min: float = 0.5) -> DataFrame:
    """The runs of masks that a detection above the confidence has. detections: image_id, mask_key, confidence; mask_runs: image_id, mask_key and the runs."""
    kept = filter_confidence(detections, confidence_min).select("image_id", "mask_key").distinct()
    return mask_runs.join(kept, ["image_id", "mask_key"], "left_semi")


def detection_summary(detections: DataFrame, images: DataFrame, union_px: DataFrame, width: int, height: int, confidence_min: float = 0.5, nested: bool = True) -> DataFrame:
    """One document per image (images without detections too): count, statistics of the confidences rounded to four
    places, union pixels and their share; nested: with the detections by index. union_px: image_id, union_px, of the masks that :func:`detected_masks` keeps."""
    rows = filter_confidence(detections, confidence_min).withColumn("c", F.round(F.col("confidence").cast("double"), 4))
    one = F.struct(
        F.col("idx").alias("index"), F.col("c").alias("confidence"), F.array(*[F.round(x, 1) for x in ("x1", "y1", "x2", "y2")]).alias("bbox_xyxy"), F.round(F.col("x2") - F.col("x1"), 1).alias("bbox_width"),
        F.round(F.col("y2") - F.col("y1"), 1).alias("bbox_height"), F.col("mask_pixels"), F.round(F.col("mask_pixels") / (width * height), 6).alias("mask_area_ratio"),
    )
    aggs = [F.count("*").alias("detection_count"), F.round(F.avg("c"), 4).alias("mean_confidence"), F.min("c").alias("min_confidence"), F.max("c").alias("max_confidence")]
    if nested:
        aggs.append(F.array_sort(F.collect_list(one)).alias("detections"))
    per = rows.groupBy("image_id").agg(*aggs)
    out = images.select("image_id").distinct().join(per, "image_id", "left").join(union_px, "image_id", "left")
    px = F.coalesce("union_px", F.lit(0)).cast("long")
    if nested:
        out = out.withColumn("detections", F.coalesce("detections", F.array().cast(out.schema["detections"].dataType)))
    return out.withColumns({"detection_count": F.coalesce("detection_count", F.lit(0)), "total_segmented_pixels": px, "total_segmented_ratio": F.round(px / (width * height) * 1e6) / 1e6}).drop("union_px")


def batch_summary(summaries: DataFrame, skipped: int = 0) -> DataFrame:
    """One row over all images; zeros when there are none."""
    def zero(c):
        return F.coalesce(c, F.lit(0.0))

    r = F.col("total_segmented_ratio")
    return summaries.agg(
        F.count("*").alias("images_processed"), F.lit(skipped).alias("images_skipped"), F.coalesce(F.sum("detection_count"), F.lit(0)).alias("total_detections"), zero(F.round(F.avg("detection_count"), 2)).alias("avg_detections"),
        zero(F.round(F.avg(r), 6)).alias("avg_ratio"), zero(F.round(F.min(r), 6)).alias("min_ratio"), zero(F.round(F.max(r), 6)).alias("max_ratio"),
    )
