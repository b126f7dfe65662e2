"""Readers. All give DataFrames over any store that Spark reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import mask_key
from ..schemas import DETECTION_DOCUMENT, MANIFEST, WIDTH_DOCUMENTS
from ..scratch import settle
from .png import BadImage, first_sample, grey

IMAGE = r"\.(jpe?g|png)$"


#: Files or folders that a task lists or reads.
FILES_A_TASK = 2000


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a folder and the folder's path in it."""
    return (pafs.LocalFileSystem(), uri.removeprefix("file:")) if uri.startswith("file:/") else pafs.FileSystem.from_uri(uri)


def arrow_root(spark: SparkSession, root: str) -> str | None:
    """The full name of a folder that Arrow can open; None for one that only Spark's readers can, patterns, single files and missing ones."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where) or not store.getFileStatus(where).isDirectory():
        return None
    uri = store.makeQualified(where).toString()
    try:
        fs, at = opened(uri)
        return uri if fs.get_file_info(at).type == pafs.FileType.Directory else None
    except (pa.ArrowException, OSError, ImportError):
        return None


def dealt(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(max(1, -(-rows.count() // FILES_A_TASK)), key)


def listed(spark: SparkSession, uri: str) -> DataFrame:
    """path and length of the files below a folder, but for those of 0 bytes and hidden ones, as Spark lists them. Tasks list the folders, a level at a
    time, so that the driver holds no names, however many files there are."""

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(uri)
        for batch in batches:
            for below in batch["path"].to_pylist():
                infos = fs.get_file_info(pafs.FileSelector(at + below.removeprefix(uri)))
                seen = [i for i in infos if not i.base_name.startswith(".") and (not i.base_name.startswith("_") or "=" in i.base_name)]
                for k in range(0, len(seen), 10_000):
                    part = seen[k : k + 10_000]
                    yield pa.record_batch([pa.array([f"{below}/{i.base_name}" for i in part], pa.string()), pa.array([i.size if i.is_file else None for i in part], pa.int64())], ["path", "length"])

    levels, folders = [], spark.createDataFrame([(uri,)], "path string")
    while not levels or folders.limit(1).count():
        levels.append(settle(dealt(folders, "path").mapInArrow(children, "path string, length long"), "listing"))
        folders = levels[-1].where("length is null").select("path")
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.where("length > 0")


def png_files(spark: SparkSession, root: str) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, bytes]]]]:
    """The PNG files below a folder, and what makes their path and content of its batches in a task."""
    uri = arrow_root(spark, root)
    if uri is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][nN][gG]").load(root)
        return files.select("path", "content"), lambda batches: ((path, content.as_py()) for batch in batches for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        fs, at = opened(uri)
        for batch in batches:
            for path in batch["path"].to_pylist():
                with fs.open_input_stream(at + path.removeprefix(uri)) as f:
                    yield path, f.read()

    return dealt(listed(spark, uri).where(F.lower("path").endswith(".png")).select("path"), "path"), read


def only_images(objects: DataFrame) -> DataFrame:
    return objects.where(F.lower("path").rlike(IMAGE))


def scan_image_objects(spark: SparkSession, root: str) -> DataFrame:
    """Paths and lengths of images below a folder; contents are not read."""
    uri = arrow_root(spark, root)
    if uri is not None:
        return only_images(listed(spark, uri))
    return only_images(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length"))


def line_runs(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true values."""
    padded = np.zeros((grid.shape[0], grid.shape[1] + 2), np.int8)
    padded[:, 1:-1] = grid
    edges = np.diff(padded, axis=1)
    r, c0 = np.nonzero(edges == 1)
    return r, c0, np.nonzero(edges == -1)[1] - 1


def _decoded(spark: SparkSession, root: str, found: Callable[[bytes], Iterator[dict]], fields: str) -> DataFrame:
    """path, error and ``fields`` of the PNG files below a folder: what ``found`` makes of each, or one row that says why it can't be read."""
    names = [f.split()[0] for f in fields.split(", ")]

    files, read = png_files(spark, root)

    def run(batches):
        for path, content in read(batches):
            try:
                parts = [{"path": path, "error": None, **part} for part in found(content)]
            except BadImage as e:
                parts = [{"path": path, "error": str(e)}]
            for part in parts:
                n = max([len(v) for v in part.values() if isinstance(v, np.ndarray)], default=1)
                yield pd.DataFrame({c: part[c] if isinstance(part.get(c), np.ndarray) else [part.get(c)] * n for c in ("path", "error", *names)})

    def arrow(batches):
        schema = pa.schema([("path", pa.string()), ("error", pa.string()), *[(n, pa.string() if f.endswith("string") else pa.int32()) for n, f in zip(names, fields.split(", "), strict=True)]])
        for pdf in run(batches):
            yield pa.RecordBatch.from_pandas(pdf, schema=schema, preserve_index=False)

    return files.mapInArrow(arrow, f"path string, error string, {fields}")


def scan_masks(spark: SparkSession, root: str, version: int = 2) -> DataFrame:
    """Every mask file below a folder: path, error, class_name, mask_key, height, width, r, c0, c1. A row for each horizontal run of grey above 127
    (colours by integer luma); a file without such pixels gives one row without a run, a file that can't be decoded one with the reason in ``error``. Spark lists no files of 0 bytes."""

    def found(content: bytes):
        g = grey(content)
        r, c0, c1 = line_runs(g > 127)
        yield {"height": g.shape[0], "width": g.shape[1], **({"r": r, "c0": c0, "c1": c1} if len(r) else {})}

    rows = _decoded(spark, root, found, "height int, width int, r int, c0 int, c1 int")
    return rows.select("path", "error", F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("class_name"), mask_key(F.col("path"), version).alias("mask_key"), "height", "width", "r", "c0", "c1")


def scan_mask_runs(spark: SparkSession, root: str, version: int = 2) -> DataFrame:
    """The runs of :func:`scan_masks`; settle that one to have the errors from the same reading."""
    return scan_masks(spark, root, version).where("r is not null").drop("error")


def scan_labels(spark: SparkSession, root: str, class_ids: dict[int, str]) -> DataFrame:
    """Every label file below a folder: path, error, label, x, y0, y1. A row for each vertical run of a class (the first sample as stored); files without
    any give one row without a run, files that can't be decoded one with the reason in ``error``."""

    def found(content: bytes):
        labels, some = first_sample(content), False
        for value, name in class_ids.items():
            x, y0, y1 = line_runs(labels.T == value)
            if len(x):
                some = True
                yield {"label": name, "x": x, "y0": y0, "y1": y1}
        if not some:
            yield {}

    return _decoded(spark, root, found, "label string, x int, y0 int, y1 int")


def scan_label_runs(spark: SparkSession, root: str, class_ids: dict[int, str]) -> DataFrame:
    """The runs of :func:`scan_labels`."""
    return scan_labels(spark, root, class_ids).where("x is not null").drop("error")


def place_in_files() -> Column:
    """A place that orders lines by file name, and inside a file as they stand: a file's splits are told apart by where
    they begin, and their rows by the ids of one task, which grow."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n"))


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows, the last of each (segment, point, direction) in order of file names and lines."""
    rows = spark.read.csv(path, schema=MANIFEST, header=True, mode="PERMISSIVE").withColumn("_n", place_in_files())
    w = W.partitionBy("segment_id", "point_id", "direction").orderBy(F.desc("_n"))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_n")


def strict_rows(lines: DataFrame, header: str) -> DataFrame:
    """Fields of CSV lines (value, line_no): quotes are understood, blank lines, the header and rows shorter than the
    header go, fields past the header are cut."""
    names = [c.strip().strip('"') for c in header.split(",")]
    bare = F.regexp_replace("value", '"(?:[^"]|"")*"', "")
    commas = F.length(bare) - F.length(F.regexp_replace(bare, ",", ""))
    kept = lines.where((F.trim("value") != "") & (F.col("value") != header) & (commas >= len(names) - 1))
    fields = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(len(names)))), {"quote": '"', "escape": '"'})
    return kept.withColumn("_f", fields).select("line_no", *[F.col(f"_f.c{i}").alias(n) for i, n in enumerate(names)])


def scan_manifest_strict(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows as the viewer reads them; the first line of the first file names the columns."""
    lines = spark.read.text(path).withColumn("line_no", place_in_files())
    header = lines.agg(F.min_by("value", "line_no")).first()[0]
    if header is None:
        return spark.createDataFrame([], "line_no long")
    return strict_rows(lines, header)


def scan_detection_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Detections of nested documents, one row each; documents without any give one row of nulls."""
    docs = spark.read.schema(DETECTION_DOCUMENT).option("recursiveFileLookup", "true").json(root, multiLine=True)
    return docs.select("source", "prompt", "image_width", "image_height", "detection_count", "summary", F.explode_outer("detections").alias("d")).select("source", "prompt", "image_width", "image_height", "detection_count", "summary", "d.*")


def scan_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """id and central_width; rows that can't be read go, the last row of an id wins (by file name and line); no file, no rows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "id int, central_width double")
    return truth_rows(spark.read.csv(path, header=True, schema="id string, central_width string").withColumn("line_no", place_in_files()))


def truth_rows(raw: DataFrame) -> DataFrame:
    rows = raw.select(F.col("id").try_cast("int").alias("id"), F.col("central_width").try_cast("double").alias("central_width"), "line_no").dropna()
    return rows.groupBy("id").agg(F.max_by("central_width", "line_no").alias("central_width"))


def scan_width_metadata(spark: SparkSession, root: str, kind: str = "width") -> DataFrame:
    """Width, footprint or alternative width documents with their path."""
    return spark.read.schema(WIDTH_DOCUMENTS[kind]).option("recursiveFileLookup", "true").json(root, multiLine=True).withColumn("path", F.input_file_name())


def scan_street_graph(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(nodes), spark.read.parquet(edges)


def scan_point_cloud(clouds: DataFrame) -> DataFrame:
    """Finite points of rows with image_id, width and flat ``points`` (x, y, z, x, ...): image_id, yd, xd, x, y, z."""
    n = F.floor(F.size("points") / 3).cast("int")
    k = F.col("_k")
    rows = clouds.where(n > 0).select("image_id", "width", "points", F.explode(F.sequence(F.lit(0), n - 1)).alias("_k"))
    rows = rows.select("image_id", F.floor(k / F.col("width")).cast("int").alias("yd"), (k % F.col("width")).cast("int").alias("xd"), *[F.get("points", k * 3 + i).cast("double").alias(c) for i, c in enumerate("xyz")])
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in "xyz"]
    return rows.where(ok[0] & ok[1] & ok[2])
