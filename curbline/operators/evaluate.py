"""Predictions against ground truth, and reasons for skipped images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_predictions_truth(predictions: DataFrame, truth: DataFrame, how: str = "left") -> DataFrame:
    rows = predictions.join(truth, "id", how)
    return rows.withColumn("abs_error", F.abs(F.col("predicted_width") - F.col("central_width")))


def width_metrics(joined: DataFrame) -> DataFrame:
    """One row: errors over the rows that have a truth."""
    e = F.col("predicted_width") - F.col("central_width")
    return joined.where(F.col("central_width").isNotNull()).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.percentile(F.abs(e), F.lit(0.5)).alias("median_ae"), F.avg(e).alias("bias"), F.stddev_pop(e).alias("error_std"),
        (F.avg((F.abs(e) < 0.25).cast("double")) * 100).alias("pct_25cm"), (F.avg((F.abs(e) < 0.5).cast("double")) * 100).alias("pct_50cm"),
    )


def skip_breakdown(skips: DataFrame) -> DataFrame:
    """Count by reason, most frequent first, with the class of the reason (Q quality, M measurement, E error)."""
    return skips.groupBy("reason").agg(F.count("*").alias("n")).withColumn("class", F.split_part("reason", F.lit(":"), F.lit(1))).orderBy(F.desc("n"), "reason")


def worst_predictions(joined: DataFrame, n: int = 10) -> DataFrame:
    return joined.where(F.col("abs_error").isNotNull()).orderBy(F.desc("abs_error"), "id").limit(n)
