"""Row filters over images, points, detections and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, in_polygon
from ..functions.names import numeric_prefix


def filter_id_range(images: DataFrame, low: int, high: int, start: int | None = None, id_key: str = "leading", path: str = "path") -> DataFrame:
    """Rows whose id lies in the range (resumed from ``start``), with the id, in its order; rows without an id go."""
    first = max(low, start) if start is not None else low
    return images.withColumn("num", numeric_prefix(F.col(path), id_key)).where(F.col("num").between(first, high)).orderBy("num", path)


def filter_area_polygon(points: DataFrame, vertices: list[tuple[float, float]]) -> DataFrame:
    lats, lons = [v[0] for v in vertices], [v[1] for v in vertices]
    box = F.col("latitude").between(min(lats), max(lats)) & F.col("longitude").between(min(lons), max(lons)) if vertices else F.lit(True)
    return points.where(box & in_polygon(F.col("latitude"), F.col("longitude"), vertices))


def filter_area_bbox(points: DataFrame, north: float, south: float, east: float, west: float) -> DataFrame:
    return points.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def filter_area_radius(points: DataFrame, lat: float, lon: float, dist_m: float = 500.0) -> DataFrame:
    """Points within a distance; a box of latitudes is tested first, so scans can skip row groups."""
    reach = dist_m / 111_000.0 * 1.01
    near = F.col("latitude").between(lat - reach, lat + reach)
    return points.where(near & (haversine_m(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)) <= dist_m))


def filter_direction(images: DataFrame, directions: tuple[str, ...] = ("forward", "backward")) -> DataFrame:
    return images.where(F.col("direction").isin(*directions))


def filter_confidence(detections: DataFrame, confidence_min: float = 0.5) -> DataFrame:
    """Strictly above the minimum."""
    return detections.where(F.col("confidence") > confidence_min)


def filter_min_length(segments: DataFrame, min_m: float = 1.0, order: str = "segment_id", ids: str = "new_id") -> DataFrame:
    """Segments of at least the length, numbered anew from 0 in their order."""
    from .graph import sequence_ids

    return sequence_ids(segments.where(F.col("length") >= min_m), [order], ids)


def filter_path_allowlist(objects: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Objects under any allowed prefix (``prefix`` column; a slash is added where it lacks).

    Prefixes are joined by their first path part, so no pair of other folders is looked at."""
    allowed = prefixes.select(F.regexp_replace("prefix", "/*$", "/").alias("_prefix")).distinct().withColumn("_top", F.split_part("_prefix", F.lit("/"), F.lit(1)))
    rows = objects.withColumn("_top", F.split_part("path", F.lit("/"), F.lit(1)))
    return rows.join(allowed, (rows["_top"] == allowed["_top"]) & rows["path"].startswith(allowed["_prefix"]), "left_semi").drop("_top")


def search_points(points: DataFrame, query: str, found: int = 20, shown: int = 8) -> DataFrame:
    """Point ids that contain the trimmed query, the first 20 in order; the first 8 of all for an empty query."""
    q = query.strip()
    ids = points.select("point_id").distinct()
    return ids.where(F.col("point_id").contains(q)).orderBy("point_id").limit(found) if q else ids.orderBy("point_id").limit(shown)


def report_is_valid() -> Column:
    def full(c: str) -> Column:
        return F.length(F.coalesce(F.col(c), F.lit(""))) > 0

    return full("point_id") & full("direction") & (F.length(F.trim(F.coalesce(F.col("description"), F.lit("")))) > 0)


def filter_report_valid(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid reports with the description trimmed, and the rejects."""
    ok = report_is_valid()
    return reports.where(ok).withColumn("description", F.trim("description")), reports.where(~ok)


def quality_gate(label_runs: DataFrame, width: int, height: int, min_sidewalk: float = 0.02, min_road: float = 0.01, band_frac: float = 0.2, min_columns: float = 0.3) -> DataFrame:
    """image_id, ok and the first failed gate's reason, from merged column runs (x, y0, y1 inclusive)."""
    half = max(10, int(width * band_frac / 2))
    low, high = max(0, width // 2 - half), min(width, width // 2 + half)
    px = F.col("y1") - F.col("y0") + 1
    per = label_runs.groupBy("image_id").agg(
        F.sum(F.when(F.col("label") == "sidewalk", px).otherwise(0)).alias("sw"),
        F.sum(F.when(F.col("label") == "road", px).otherwise(0)).alias("road"),
        F.countDistinct(F.when((F.col("label") == "sidewalk") & (F.col("x") >= low) & (F.col("x") < high), F.col("x"))).alias("cols"),
    )
    reason = (
        F.when(F.col("sw") / (width * height) < min_sidewalk, "Q:sw_area_small")
        .when(F.col("road") / (width * height) < min_road, "Q:road_area_small")
        .when(F.col("cols") / (high - low) < min_columns, "Q:midline_coverage_low")
        .otherwise("")
    )
    return per.select("image_id", (reason == "").alias("ok"), reason.alias("reason"))


def availability_gate(points: DataFrame) -> DataFrame:
    return points.where(F.col("status") == "OK")


def first_per(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
