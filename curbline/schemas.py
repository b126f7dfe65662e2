"""Explicit schemas of the documents and tables that are read; nothing is inferred."""

from __future__ import annotations

MANIFEST = "segment_id string, point_id string, point_type string, direction string, status string, gcs_uri string, latitude double, longitude double, pano_id string, pano_lat double, pano_lng double, street_bearing double, heading double, pitch double"
DETECTION = "index int, confidence double, bbox_xyxy array<double>, bbox_width double, bbox_height double, mask_pixels long, mask_area_ratio double"
DETECTION_DOCUMENT = f"source string, timestamp string, image_width int, image_height int, total_pixels long, prompt string, confidence_threshold double, detection_count int, detections array<struct<{DETECTION.replace(' ', ':').replace(',:', ',')}>>, summary struct<total_segmented_pixels:bigint,total_segmented_ratio:double,mean_confidence:double,min_confidence:double,max_confidence:double>, inference_time_s double"
WIDTH_DOCUMENTS = {
    "width": "segment string, width_cm struct<median:double,mean:double,std:double,min:double,max:double>, rows_used int",
    "footprint": "segment string, rectified_height int, rectified_width int, sidewalk_target_width_px int, padding_px int, sidewalk_area_px bigint, obstacles array<struct<type:string,method:string,bbox_xyxy:array<double>,footprint_width_px:int,footprint_height_px:int,footprint_area_px:bigint,full_silhouette_area_px:bigint,reduction_pct:double>>",
    "alt": "source_image_blob string, point_id string, direction string, coordinate_folder string, lat string, lon string, heading string, status string, reason string, width_m double, n_cols int, processed_utc string",
}
REPORT = "pointId string, direction string, latitude double, longitude double, description string, timestamp string"
STORED_REPORT = "point_id string, direction string, latitude double, longitude double, description string, timestamp string, received timestamp, key string"
