"""Writers and the rows they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.plugins import junction_analyzer, junction_documents


def sink_manifest(df: DataFrame, path: str, order: str = "line_no") -> None:
    """CSV with a header, in run order (range-partitioned, so files follow one another)."""
    rows = df.orderBy(order).drop(order) if order in df.columns else df
    rows.write.mode("overwrite").csv(path, header=True)


def sink_run_metadata(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)  # one row


def in_few_files(df: DataFrame, *folders: str) -> DataFrame:
    """Rows of a folder together, so that a small folder gets one file of a write; Spark splits a folder far larger than others."""
    return df.hint("rebalance", *folders)


def sink_segment_documents(df: DataFrame, path: str) -> None:
    """JSON documents in folders by coordinates, direction and segment, a file a folder unless it is very large."""
    folders = ("coordinate_folder", "direction", "segment")
    in_few_files(df, *folders).write.mode("overwrite").partitionBy(*folders).json(path)


def four(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).otherwise("")


def prediction_rows(joined: DataFrame) -> DataFrame:
    """id and texts of four decimals, blank without a truth, by id."""
    return joined.select("id", four("predicted_width").alias("predicted_width"), four("central_width").alias("ground_truth"), four("abs_error").alias("abs_error")).orderBy("id")


def sink_predictions_csv(joined: DataFrame, path: str) -> None:
    prediction_rows(joined).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def skip_rows(skips: DataFrame) -> DataFrame:
    return skips.select("id", "reason").orderBy("id", "reason")


def sink_skip_report(skips: DataFrame, path: str) -> None:
    skip_rows(skips).write.mode("overwrite").csv(path, header=True)


def geojson_features(points: DataFrame) -> DataFrame:
    """One GeoJSON feature per point."""
    shape = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    about = F.struct(F.col("point_id").alias("pointId"), F.col("bearing"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), about.alias("properties"))).alias("feature"))


def sink_geojson(points: DataFrame, path: str) -> None:
    geojson_features(points).write.mode("overwrite").text(path)


def junction_stubs(images: DataFrame) -> DataFrame:
    """A stub document for each image of a junction. images: image_id, image_blob, masks_prefix, point_type and, where there is, metadata."""
    return junction_documents(junction_analyzer(images.where("point_type = 'junction'")))


def sink_junction_stub(images: DataFrame, path: str) -> None:
    junction_stubs(images).select("document").write.mode("overwrite").text(path)
