"""Continuous intake of citizen reports, and compaction of what it wrote."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import report_key
from ..operators.filters import filter_report_valid
from ..schemas import REPORT, STORED_REPORT
from ..scratch import delete
from ..sources.writers import in_few_files


def prepared(raw: DataFrame) -> DataFrame:
    return raw.withColumnRenamed("pointId", "point_id").withColumn("received", F.current_timestamp())


def _write(reports: DataFrame, path: str, buckets: int | None) -> None:
    """A folder a point and direction, or a folder a bucket of points, whose files then hold both columns."""
    if buckets is None:
        folders = ["point_id", "direction"]
    else:
        folders = ["bucket"]
        reports = reports.withColumn("bucket", F.pmod(F.xxhash64("point_id"), F.lit(buckets)).cast("int"))
    in_few_files(reports, *folders).write.mode("overwrite").partitionBy(*folders).json(path)


def stream_reports(spark: SparkSession, src: str, out: str, checkpoint: str, buckets: int | None = None, **trigger) -> StreamingQuery:
    """Validate report documents as they arrive; append the good ones below out/reports by point and direction, the
    others below out/rejects. A batch that is run again writes the same folder anew, so each report comes once.

    A folder a point and direction is a file of its own for every few reports: with points by the ten thousand, take ``buckets``, and points
    are dealt over that many folders by their hash. What is stored is the same; readers find either."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        ok, bad = filter_report_valid(batch)
        ok = ok.withColumn("key", report_key(F.col("point_id"), F.col("direction"), F.coalesce(F.col("timestamp").try_cast("timestamp"), F.col("received"))))
        _write(ok, f"{out}/reports/batch={number}", buckets)
        bad.write.mode("overwrite").json(f"{out}/rejects/batch={number}")
        batch.unpersist()

    rows = prepared(spark.readStream.schema(REPORT).json(src))
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _numbers(spark: SparkSession, folder: str, lead: str) -> list[int]:
    """Numbers of the complete folders ``lead=number`` in a folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    paths = [s.getPath() for s in fs.listStatus(where) if s.isDirectory()]
    done = [p.getName() for p in paths if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done if n.startswith(f"{lead}=") and n.split("=")[1].isdigit())


def _together(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Each folder is read by itself: its own partition folders begin below it."""
    found = [spark.read.schema(STORED_REPORT).json(f).drop("bucket") for f in folders]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], STORED_REPORT)


def read_reports(spark: SparkSession, out: str) -> DataFrame:
    """All reports taken in so far, each once: the last compaction and the batches after it."""
    upto = max(_numbers(spark, f"{out}/compacted", "upto"), default=-1)
    folders = [f"{out}/compacted/upto={upto}"] * (upto >= 0) + [f"{out}/reports/batch={n}" for n in _numbers(spark, f"{out}/reports", "batch") if n > upto]
    return _together(spark, folders)


def compact_reports(spark: SparkSession, out: str, keep_batches: int = 1, buckets: int | None = None) -> int | None:
    """Write what was taken in, but for the last ``keep_batches`` batches, as one set of files, a file a point and direction (or a bucket of
    points, see :func:`stream_reports`); the number of the last batch in it, or None if there is nothing to do.

    A compaction counts once its _SUCCESS file is there, and readers then pass over the batches it holds; only after that are they deleted. So a run that
    dies anywhere loses no report and doubles none, and the next run does the rest."""
    before = _numbers(spark, f"{out}/compacted", "upto")
    batches = _numbers(spark, f"{out}/reports", "batch")
    last = max(before, default=-1)
    new = [n for n in batches[: len(batches) - keep_batches or None] if n > last] if len(batches) > keep_batches else []
    if new:
        rows = _together(spark, [f"{out}/compacted/upto={last}"] * (last >= 0) + [f"{out}/reports/batch={n}" for n in new])
        last = new[-1]
        _write(rows, f"{out}/compacted/upto={last}", buckets)
    for n in before:
        if n < last:
            delete(spark, f"{out}/compacted/upto={n}")
    for n in batches:
        if n <= last:
            delete(spark, f"{out}/reports/batch={n}")
    return last if new else None

