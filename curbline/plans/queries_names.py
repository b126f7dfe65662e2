"""Queries: scans, sinks, names, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, names
from ..operators import filters as fl
from ..operators import resolve
from ..sources import readers, writers
from .base import query

PARSED = r"""o AS (SELECT object_id, path, regexp_extract(path, '[^/]*$') AS base FROM fx_objects),
m AS (SELECT object_id, path, base,
  regexp_matches(base, '^(\d+)-(\d+)_(forward|backward|left|right)_([-\d.]+)_([-\d.]+)_([\d.]+)\.\w+$') AS two,
  regexp_matches(base, '^(\d+)_(forward|backward|left|right)_([-\d.]+)_([-\d.]+)_([\d.]+)\.\w+$') AS one FROM o),
p AS (SELECT object_id, path,
  CASE WHEN two THEN regexp_extract(base, '^(\d+)-', 1) ELSE '0' END AS segment_id,
  CASE WHEN two THEN regexp_extract(base, '^\d+-(\d+)_', 1) ELSE regexp_extract(base, '^(\d+)_', 1) END AS point_id,
  regexp_extract(base, '_(forward|backward|left|right)_', 1) AS direction,
  regexp_extract(base, '_([-\d.]+)_([-\d.]+)_([\d.]+)\.\w+$', 1) AS lat, regexp_extract(base, '_([-\d.]+)_([-\d.]+)_([\d.]+)\.\w+$', 2) AS lon,
  regexp_extract(base, '_([-\d.]+)_([-\d.]+)_([\d.]+)\.\w+$', 3) AS heading FROM m WHERE one OR two)"""

PARTS = ("segment_id", "point_id", "direction", "lat", "lon", "heading", "coordinate_folder")


def parsed(d):
    rows = d.fx_objects.withColumn("p", names.parse_image_name(F.col("path"))).where("p is not null")
    return rows.select("object_id", "path", *[F.col(f"p.{c}").alias(c) for c in PARTS])


def written_png(rows: "DataFrame", folder: str) -> "DataFrame":
    """Write one PNG for each row (path, height, width, spans of [line, first, last, value], later ones over earlier) and give the paths.
    A further column ``kind`` makes it other than grey: green or red of that value, a file that ends early, or one whose lines
    are columns (upright). Spans come as one flat array a row, so that a batch is no more in Python than its numbers."""

    def run(batches):
        import struct
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            ends, flat = batch["spans"].offsets.to_numpy(), batch["spans"].values.to_numpy()
            for i in range(batch.num_rows):
                path, h, w, kind = (batch[c][i].as_py() for c in ("path", "h", "w", "kind"))
                grid = np.zeros((w, h) if kind == "upright" else (h, w), np.uint8)
                for line, first, last, value in flat[ends[i] : ends[i + 1]].reshape(-1, 4):
                    grid[line, first : last + 1] = value
                grid = grid.T if kind == "upright" else grid
                if kind in ("red", "green"):
                    grid = np.stack([grid * (kind == c) for c in ("red", "green", "blue")], axis=2).reshape(h, 3 * w)
                raw = zlib.compress(np.pad(grid, ((0, 0), (1, 0))).tobytes(), 1)[: 20 if kind == "cut" else None]
                chunks = [(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if kind in ("red", "green") else 0, 0, 0, 0)), (b"IDAT", raw), (b"IEND", b"")]
                fs.create_dir(f"{root}/{path}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{root}/{path}") as out:
                    out.write(b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x)) for k, x in chunks))
            yield pa.record_batch([batch["path"]], ["path"])

    kind = F.col("kind") if "kind" in rows.columns else F.lit("grey")
    return rows.select("path", "h", "w", F.flatten("spans").alias("spans"), kind.alias("kind")).mapInArrow(run, "path string")


@query("scan_image_objects", r"SELECT DISTINCT regexp_extract(path, '[^/]*$') AS name, CAST(length(path) AS BIGINT) AS length FROM fx_objects WHERE object_id % 100 < 2 AND regexp_matches(lower(path), '\.(jpe?g|png)$')")
def _(d):
    folder = d.scratch("objects")
    some = d.fx_objects.where("object_id % 100 < 2")  # a file each: the fixture's size, not the operator's

    def run(batches):
        import pandas as pd
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        for pdf in batches:
            for path in pdf["path"]:
                fs.create_dir(f"{root}/{path}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{root}/{path}") as out:
                    out.write(path.encode())
            yield pd.DataFrame({"path": pdf["path"]})

    some.select("path").mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()
    return readers.scan_image_objects(d.spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("scan_mask_runs", """WITH c AS (SELECT image_id, class_name, r, c0, c1, max(c1) OVER (PARTITION BY image_id, class_name, r ORDER BY c0, c1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fx_mask_runs WHERE class_name <> 'car' AND (class_name <> 'road' OR image_id % 4 <> 0)),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR c0 > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, class_name, r ORDER BY c0, c1) AS run FROM c)
SELECT CAST(image_id AS VARCHAR) AS image, class_name, 480 AS height, 640 AS width, r, min(c0) AS c0, max(c1) AS c1, '' AS error FROM n GROUP BY image_id, class_name, r, run
UNION ALL SELECT DISTINCT CAST(image_id AS VARCHAR), class_name, 480, 640, -1, -1, -1, '' FROM fx_mask_runs WHERE class_name = 'car'
UNION ALL SELECT DISTINCT CAST(image_id AS VARCHAR), class_name, -1, -1, -1, -1, -1, 'too few pixels' FROM fx_mask_runs WHERE class_name = 'road' AND image_id % 4 = 0""")
def _(d):
    """Trees in green (luma 150 of 255: above 127), cars in red (76: below), every fourth image's road cut short."""
    folder = d.scratch("masks")
    rows = d.fx_mask_runs.groupBy("image_id", "class_name").agg(F.collect_list(F.array("r", "c0", "c1", F.lit(255))).alias("spans"))  # an image's runs
    kind = F.when(F.col("class_name") == "tree", "green").when(F.col("class_name") == "car", "red").when((F.col("class_name") == "road") & (F.col("image_id") % 4 == 0), "cut").otherwise("grey")
    written_png(rows.select(F.concat_ws("/", F.lit("run"), F.col("image_id").cast("string"), F.col("class_name"), F.lit("mask.png")).alias("path"), F.lit(480).alias("h"), F.lit(640).alias("w"), "spans", kind.alias("kind")), folder).write.format("noop").mode("overwrite").save()
    got = readers.scan_masks(d.spark, folder).na.fill(-1, ["height", "width", "r", "c0", "c1"]).na.fill("", ["error"])
    return got.select(F.element_at(F.split("path", "/"), -3).alias("image"), "class_name", "height", "width", "r", "c0", "c1", "error")


@query("scan_label_runs", """WITH p AS (SELECT image_id, x, max(CASE label WHEN 'sidewalk' THEN 1 ELSE 2 END) AS k, generate_series AS y FROM fx_label_runs, generate_series(y0, y1) GROUP BY image_id, x, y),
n AS (SELECT *, y - row_number() OVER (PARTITION BY image_id, x, k ORDER BY y) AS run FROM p)
SELECT CAST(image_id AS VARCHAR) AS image, CASE k WHEN 1 THEN 'sidewalk' ELSE 'road' END AS label, x, CAST(min(y) AS INTEGER) AS y0, CAST(max(y) AS INTEGER) AS y1 FROM n GROUP BY image_id, k, x, run""")
def _(d):
    """Both classes in one raster a file; where they overlap the road is drawn last."""
    folder = d.scratch("labels")
    k = F.when(F.col("label") == "sidewalk", 1).otherwise(2)
    drawn = d.fx_label_runs.groupBy("image_id").agg(F.array_sort(F.collect_list(F.array(k, "x", "y0", "y1"))).alias("_s"))  # an image's runs
    rows = drawn.select("image_id", F.transform("_s", lambda s: F.array(s[1], s[2], s[3], s[0])).alias("spans"))
    written_png(rows.select(F.concat(F.col("image_id").cast("string"), F.lit(".png")).alias("path"), F.lit(480).alias("h"), F.lit(640).alias("w"), "spans", F.lit("upright").alias("kind")), folder).write.format("noop").mode("overwrite").save()
    got = readers.scan_label_runs(d.spark, folder, {1: "sidewalk", 2: "road"})
    return got.select(F.regexp_extract("path", r"(\d+)\.png$", 1).alias("image"), "label", "x", "y0", "y1")


MANIFEST_SQL = "SELECT segment_id, point_id, point_type, status, latitude, longitude, pano_id, row_number() OVER (PARTITION BY segment_id, point_id ORDER BY pano_id DESC) AS rn FROM (SELECT CAST(segment_id AS VARCHAR) AS segment_id, CAST(point_id AS VARCHAR) AS point_id, point_type, status, latitude, longitude, pano_id FROM fx_points)"


@query("scan_manifest", f"SELECT segment_id, point_id, point_type, status, latitude, longitude, pano_id FROM ({MANIFEST_SQL}) WHERE rn = 1")
def _(d):
    from ..schemas import MANIFEST

    folder = d.scratch("manifest")
    rows = d.fx_points.withColumns({"direction": F.lit("forward"), "segment_id": F.col("segment_id").cast("string"), "point_id": F.col("point_id").cast("string")})
    columns = [c.split()[0] for c in MANIFEST.split(", ")]
    full = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])
    full.write.csv(folder, header=True)
    return readers.scan_manifest(d.spark, folder).select("segment_id", "point_id", "point_type", "status", "latitude", "longitude", "pano_id")


@query("scan_manifest_strict", "SELECT CAST(point_id AS VARCHAR) AS point_id, point_type, status || ', ok' AS note FROM fx_points WHERE point_id % 50 <> 0")
def _(d):
    folder = d.scratch("strict")
    rows = d.fx_points.select(F.concat_ws(",", "point_id", "point_type", F.concat(F.lit('"'), "status", F.lit(', ok"'))).alias("value"), "point_id")
    short = rows.select(F.when(F.col("point_id") % 50 == 0, F.col("point_id").cast("string")).otherwise(F.col("value")).alias("value"))
    head = F.lit("point_id,point_type,note")
    # a union's partitions follow one another, so the header is the first file; a sort would bring all rows of one order into one task
    d.spark.range(0, 1, 1, 1).select(head.alias("value")).unionByName(short).write.text(folder)
    return readers.scan_manifest_strict(d.spark, folder).drop("line_no")


@query("scan_ground_truth", "SELECT CAST(id AS INTEGER) AS id, central_width FROM fx_truth")
def _(d):
    folder = d.scratch("truth")
    good = d.fx_truth.select(F.col("id").cast("string").alias("id"), F.col("central_width").cast("string").alias("central_width"))
    bad = d.fx_truth.where("id % 10 = 1").select(F.concat(F.lit("x"), F.col("id")).alias("id"), F.lit("wide").alias("central_width"))
    good.unionByName(bad).write.csv(folder, header=True)
    return readers.scan_ground_truth(d.spark, folder)


@query("scan_street_graph", "SELECT e.edge_id, e.u, e.v, e.length, e.name, n.degree FROM fx_edges e JOIN (SELECT node_id, count(*) AS degree FROM (SELECT u AS node_id FROM fx_edges UNION ALL SELECT v FROM fx_edges) GROUP BY ALL) n ON n.node_id = e.u")
def _(d):
    ends, streets = d.scratch("nodes"), d.scratch("edges")
    d.fx_edges.write.parquet(streets)
    d.fx_edges.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree")).write.parquet(ends)
    nodes, edges = readers.scan_street_graph(d.spark, ends, streets)
    return edges.join(nodes, edges["u"] == nodes["node_id"]).drop("node_id")


@query("scan_point_cloud", "SELECT vec_id AS image_id, CAST(floor(k / 7) AS INTEGER) AS yd, CAST(k % 7 AS INTEGER) AS xd, CAST(embedding[3*k+1] AS DOUBLE) AS x, CAST(embedding[3*k+2] AS DOUBLE) AS y, CAST(embedding[3*k+3] AS DOUBLE) AS z FROM embeddings, (SELECT unnest(generate_series(0, 20)) AS k) g")
def _(d):
    return readers.scan_point_cloud(d.embeddings.select(F.col("vec_id").alias("image_id"), F.lit(7).alias("width"), F.slice("embedding", 1, 63).alias("points")))


def json_documents(rows: "DataFrame", folder: str) -> None:
    """A JSON array of documents a file: the readers take multi-line documents. Each task writes its arrays, a file each, so
    that the driver sees neither a sample of them nor a task a file."""
    text = rows.select(F.to_json(F.struct(*rows.columns)).alias("j"), F.spark_partition_id().alias("p"), F.floor(F.monotonically_increasing_id() / 5000).alias("f"))
    packed = text.groupBy("p", "f").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("j")), F.lit("]")).alias("value"))  # 5000 documents
    packed.select("value").write.option("maxRecordsPerFile", 1).text(folder)


@query("scan_detection_metadata", 'SELECT CAST(image_id AS VARCHAR) AS source, CAST(count(*) OVER (PARTITION BY image_id) AS INTEGER) AS detection_count, CAST(idx AS INTEGER) AS "index", CAST(confidence AS DOUBLE) AS confidence, mask_pixels FROM fx_detections')
def _(d):
    folder = d.scratch("detections")
    doc = d.fx_detections.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("index"), F.col("confidence").cast("double").alias("confidence"), F.col("mask_pixels")))).alias("detections"))
    json_documents(doc.select(F.col("image_id").cast("string").alias("source"), F.size("detections").alias("detection_count"), "detections"), folder)
    return readers.scan_detection_metadata(d.spark, folder).select("source", "detection_count", "index", "confidence", "mask_pixels")


@query("scan_width_metadata", "SELECT 'seg_' || id AS segment, predicted_width * 100 AS median_cm, 10 AS rows_used FROM fx_predictions")
def _(d):
    folder = d.scratch("width-documents")
    docs = d.fx_predictions.select(F.concat(F.lit("seg_"), F.col("id")).alias("segment"), F.struct((F.col("predicted_width") * 100).alias("median")).alias("width_cm"), F.lit(10).alias("rows_used"))
    json_documents(docs, folder)
    return readers.scan_width_metadata(d.spark, folder).select("segment", F.col("width_cm.median").alias("median_cm"), "rows_used")


@query("sink_manifest", "SELECT CAST(segment_id AS VARCHAR) AS segment_id, CAST(point_id AS VARCHAR) AS point_id, latitude, longitude, pano_id, status, bearing, distance_along_m, point_type FROM fx_points")
def _(d):
    folder = d.scratch("sink-manifest")
    writers.sink_manifest(d.fx_points.withColumn("line_no", F.col("point_id")), folder)
    got = d.spark.read.csv(folder, header=True)
    return got.withColumns({c: F.col(c).cast("double") for c in ("latitude", "longitude", "bearing", "distance_along_m")})


@query("sink_run_metadata", "SELECT count(*) AS total_points, count(DISTINCT segment_id) AS segments, count(*) FILTER (point_type = 'junction') AS junction_points, count(DISTINCT pano_id) AS unique_panos, count(pano_id) - count(DISTINCT pano_id) AS duplicates, count(*) AS uploaded, CAST(0 AS BIGINT) AS failed, CAST(1 AS BIGINT) AS directions FROM fx_points")
def _(d):
    folder = d.scratch("run-metadata")
    writers.sink_run_metadata(resolve.run_counters(d.fx_points, d.fx_points.withColumns({"status": F.lit("uploaded"), "direction": F.lit("forward")})), folder)
    return d.spark.read.json(folder)


@query("sink_segment_documents", "SELECT 'img' || (image_id % 20) AS coordinate_folder, 'forward' AS direction, mask_key AS segment, image_id, count(*) AS runs FROM fx_mask_runs GROUP BY image_id, mask_key")
def _(d):
    folder = d.scratch("segment-documents")
    rows = d.fx_mask_runs.groupBy("image_id", "mask_key").agg(F.count("*").alias("runs"))
    writers.sink_segment_documents(rows.select(F.concat(F.lit("img"), F.col("image_id") % 20).alias("coordinate_folder"), F.lit("forward").alias("direction"), F.col("mask_key").alias("segment"), "image_id", "runs"), folder)
    return d.spark.read.json(folder)


JOINED = "j AS (SELECT p.id, p.predicted_width, t.central_width, abs(p.predicted_width - t.central_width) AS abs_error FROM fx_predictions p LEFT JOIN fx_truth t USING (id))"


@query("sink_predictions_csv", f"WITH {JOINED} SELECT id, printf('%.4f', predicted_width) AS predicted_width, coalesce(printf('%.4f', central_width), '') AS ground_truth, coalesce(printf('%.4f', abs_error), '') AS abs_error FROM j")
def _(d):
    from ..operators.evaluate import join_predictions_truth

    folder = d.scratch("predictions")
    writers.sink_predictions_csv(join_predictions_truth(d.fx_predictions, d.fx_truth), folder)
    got = d.spark.read.csv(folder, header=True, schema="id long, predicted_width string, ground_truth string, abs_error string")
    return got.fillna("", ["ground_truth", "abs_error"])


@query("sink_skip_report", "SELECT id, reason FROM fx_skips ORDER BY id, reason")
def _(d):
    folder = d.scratch("skips")
    writers.sink_skip_report(d.fx_skips, folder)
    return d.spark.read.csv(folder, header=True, schema="id long, reason string")


@query("sink_geojson", "SELECT point_id AS id, 'Feature' AS feature, 'Point' AS shape, longitude, latitude, bearing FROM fx_points")
def _(d):
    folder = d.scratch("geojson")
    writers.sink_geojson(d.fx_points, folder)
    kind = "type string, geometry struct<type: string, coordinates: array<double>>, properties struct<pointId: bigint, bearing: double>"
    f = d.spark.read.schema(kind).json(folder)
    return f.select(F.col("properties.pointId").alias("id"), F.col("type").alias("feature"), F.col("geometry.type").alias("shape"), F.get("geometry.coordinates", F.lit(0)).alias("longitude"), F.get("geometry.coordinates", F.lit(1)).alias("latitude"), "properties.bearing")


@query("sink_junction_stub", "SELECT point_id AS image_id, 'junction_stub' AS status, 'pano/' || pano_id || '.jpg' AS image_blob, CASE WHEN point_id % 3 <> 0 THEN 'masks/' || point_id END AS masks_prefix, segment_id AS meta_segment, 'forward' AS meta_direction, true AS all_fields FROM fx_points WHERE point_type = 'junction'")
def _(d):
    folder = d.scratch("stubs")
    blob, prefix = F.concat(F.lit("pano/"), "pano_id", F.lit(".jpg")), F.when(F.col("point_id") % 3 != 0, F.concat(F.lit("masks/"), "point_id"))
    meta = F.struct("segment_id", "point_id", F.lit("forward").alias("direction"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    writers.sink_junction_stub(d.fx_points.select(F.col("point_id").alias("image_id"), "point_type", blob.alias("image_blob"), prefix.alias("masks_prefix"), meta.alias("metadata")), folder)
    got = d.spark.read.text(folder)
    at = lambda path: F.get_json_object("value", path)
    keys = F.array_sort(F.json_object_keys("value")) == F.array(*map(F.lit, ("analysis", "image_blob", "masks_prefix", "metadata", "status")))
    return got.select(at("$.metadata.point_id").cast("long").alias("image_id"), at("$.status").alias("status"), at("$.image_blob").alias("image_blob"), at("$.masks_prefix").alias("masks_prefix"), at("$.metadata.segment_id").cast("long").alias("meta_segment"), at("$.metadata.direction").alias("meta_direction"), keys.alias("all_fields"))


@query("parse_image_name", f"WITH {PARSED} SELECT *, point_id || '_' || lat || '_' || lon AS coordinate_folder FROM p")
def _(d):
    return parsed(d)


@query("numeric_prefix", r"SELECT object_id, TRY_CAST(regexp_extract(regexp_extract(path, '[^/]*$'), '^(\d+)', 1) AS INTEGER) AS num FROM fx_objects")
def _(d):
    return d.fx_objects.select("object_id", names.numeric_prefix(F.col("path")).alias("num"))


@query("coordinate_folder", f"WITH {PARSED} SELECT object_id, point_id || '_' || lat || '_' || lon AS folder, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM p")
def _(d):
    rows = parsed(d).select("object_id", names.coordinate_folder(F.col("point_id"), F.col("lat"), F.col("lon")).alias("folder"))
    return rows.withColumn("g", names.parse_folder(F.col("folder"))).select("object_id", "folder", "g.lat", "g.lon")


@query("slug", "SELECT s_suppkey, replace(lower(trim(split_part(s_name || ', City', ',', 1))), ' ', '_') AS slug FROM supplier")
def _(d):
    return d.supplier.select("s_suppkey", names.slug(F.concat("s_name", F.lit(", City"))).alias("slug"))


@query("safe_prompt", r"SELECT p_partkey, trim(regexp_replace(p_name || ' / #1', '[^\w\-]+', '_', 'g'), '_') AS prompt FROM part")
def _(d):
    return d.part.select("p_partkey", names.safe_prompt(F.concat("p_name", F.lit(" / #1"))).alias("prompt"))


@query("strip_uri", "SELECT object_id, path AS key FROM fx_objects")
def _(d):
    return d.fx_objects.select("object_id", names.strip_uri(F.concat(F.lit("gs://captures/"), F.col("path")), "captures").alias("key"))


@query("capture_key", "SELECT point_id, printf('%03d-%04d', segment_id, point_id) || '_forward_' || CAST(segment_id AS VARCHAR) || '_' || CAST(point_id AS VARCHAR) || '_' || printf('%.1f', bearing) || '.jpg' AS key FROM fx_points")
def _(d):
    return d.fx_points.select("point_id", names.capture_key(F.col("segment_id"), F.col("point_id"), F.lit("forward"), F.col("segment_id"), F.col("point_id"), F.col("bearing")).alias("key"))


MASK_PATH = "'masks/' || image_id || '_1_2/forward/' || class_name || '/mask_' || printf('%03d', r) || '.png'"


@query("mask_key", "SELECT image_id, mask_key, r, c0, class_name || '_forward_' || printf('%03d', r) AS key, class_name || '_' || printf('%03d', r) AS key_v1 FROM fx_mask_runs")
def _(d):
    path = F.format_string("masks/%d_1_2/forward/%s/mask_%03d.png", "image_id", "class_name", "r")
    return d.fx_mask_runs.select("image_id", "mask_key", "r", "c0", names.mask_key(path).alias("key"), names.mask_key(path, 1).alias("key_v1"))


@query("mask_class_flags", "SELECT DISTINCT mask_key, contains(class_name, 'sidewalk') AS is_sidewalk, split_part(lower(mask_key), '_', 1) = 'road' AS is_road, contains(lower(mask_key), 'tree') AS is_tree FROM fx_mask_runs")
def _(d):
    return d.fx_mask_runs.select("mask_key", names.mask_class_flags(F.col("mask_key"), F.col("class_name")).alias("f")).distinct().select("mask_key", "f.*")


PAIRS = "SELECT a.point_id, a.latitude AS la, a.longitude AS lo, b.latitude AS lb, b.longitude AS lp FROM fx_points a JOIN fx_points b ON b.point_id = a.point_id + 1"


def pairs(d):
    a = d.fx_points.select("point_id", F.col("latitude").alias("la"), F.col("longitude").alias("lo"))
    b = d.fx_points.select((F.col("point_id") - 1).alias("point_id"), F.col("latitude").alias("lb"), F.col("longitude").alias("lp"))
    return a.join(b, "point_id")


BEARING = "degrees(atan2(sin(radians({o2}) - radians({o1})) * cos(radians({a2})), cos(radians({a1})) * sin(radians({a2})) - sin(radians({a1})) * cos(radians({a2})) * cos(radians({o2}) - radians({o1}))))"


def pmod(x: str) -> str:
    return f"(({x}) - 360.0::DOUBLE * floor(({x}) / 360.0::DOUBLE))"


@query("bearing", f"SELECT point_id, round({pmod(BEARING.format(a1='la', o1='lo', a2='lb', o2='lp'))}, 4) AS bearing FROM ({PAIRS})")
def _(d):
    return pairs(d).select("point_id", F.round(geo.bearing(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")), 4).alias("bearing"))


@query("haversine_m", f"SELECT point_id, round(2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin((radians(lb) - radians(la)) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin(radians(lp - lo) / 2), 2))), 4) AS meters FROM ({PAIRS})")
def _(d):
    return pairs(d).select("point_id", F.round(geo.haversine_m(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")), 4).alias("meters"))


@query("camera_heading", "SELECT point_id, (bearing + 270.0::DOUBLE) % 360.0::DOUBLE AS heading FROM fx_points")
def _(d):
    return d.fx_points.select("point_id", geo.camera_heading(F.col("bearing"), F.lit(270.0)).alias("heading"))


#: The transverse Mercator series to the third order (Krueger), zone of central meridian 27 E: fixed values of the ellipsoid.
UTM = """WITH c AS (SELECT 6378137.0::DOUBLE AS a, 1 / 298.257223563::DOUBLE AS f), k AS (SELECT *, f / (2 - f) AS n FROM c),
q AS (SELECT point_id, radians(latitude) AS p, radians(longitude - 27.0::DOUBLE) AS l, 2 * sqrt(n) / (1 + n) AS e, n, a / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) AS big FROM fx_points, k),
t AS (SELECT *, sinh(atanh(sin(p)) - e * atanh(e * sin(p))) AS tau FROM q),
z AS (SELECT *, atan2(tau, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + tau * tau)) AS eta,
  [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5, 61 * n ** 3 / 240] AS al FROM t)
SELECT point_id, round(500000 + 0.9996::DOUBLE * big * (eta + list_sum([al[j] * cos(2 * j * xi) * sinh(2 * j * eta) FOR j IN [1, 2, 3]])), 2) AS x,
  round(0.9996::DOUBLE * big * (xi + list_sum([al[j] * sin(2 * j * xi) * cosh(2 * j * eta) FOR j IN [1, 2, 3]])), 2) AS y FROM z"""


@query("project_metric", UTM)
def _(d):
    p = d.fx_points.withColumn("p", geo.project_metric(F.col("longitude"), F.col("latitude"), F.lit(35)))
    return p.select("point_id", F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"))


@query("unproject_wgs84", "SELECT point_id, round(longitude, 7) AS lon, round(latitude, 7) AS lat FROM fx_points")
def _(d):
    p = d.fx_points.withColumn("p", geo.project_metric(F.col("longitude"), F.col("latitude"), F.lit(35))).withColumn("g", geo.unproject_wgs84(F.col("p.x"), F.col("p.y"), F.lit(35)))
    return p.select("point_id", F.round("g.lon", 7).alias("lon"), F.round("g.lat", 7).alias("lat"))


@query("street_name_norm", "SELECT u, coalesce(string_agg(name, ', ' ORDER BY name), 'unknown') AS name FROM (SELECT DISTINCT u, name FROM fx_edges) GROUP BY u")
def _(d):
    return d.fx_edges.groupBy("u").agg(F.array_sort(F.collect_set("name")).alias("n")).select("u", names.street_name_norm(F.col("n")).alias("name"))


@query("round_compat", "SELECT point_id, round_even(distance_along_m / 8 + 0.5, 1) AS r FROM fx_points")
def _(d):
    return d.fx_points.select("point_id", geo.round_compat(F.col("distance_along_m") / 8 + 0.5, 1).alias("r"))


@query("box_geometry", "SELECT image_id, idx, x2 - x1 AS w, y2 - y1 AS h, floor((x1 + (x2 - x1) / 2) / 640 * 1000) AS ncx, floor((y1 + (y2 - y1) / 2) / 480 * 1000) AS ncy FROM (SELECT image_id, idx, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM fx_detections)")
def _(d):
    g = geo.box_geometry(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")), 640, 480)
    rows = d.fx_detections.select("image_id", "idx", g.alias("g"))
    return rows.select("image_id", "idx", "g.w", "g.h", F.floor(F.col("g.ncx") * 1000).cast("double").alias("ncx"), F.floor(F.col("g.ncy") * 1000).cast("double").alias("ncy"))


@query("pinhole_width_cm", "SELECT image_id, mask_key, r, c0, c1, round(1.8::DOUBLE * (c1 - c0) / (r - 240.0::DOUBLE) * 100, 6) AS width_cm FROM fx_mask_runs WHERE r > 240")
def _(d):
    return d.fx_mask_runs.where("r > 240").select("image_id", "mask_key", "r", "c0", "c1", F.round(geo.pinhole_width_cm(F.col("c0"), F.col("c1"), F.col("r"), 480, 1.8), 6).alias("width_cm"))


@query("report_key", "SELECT event_id, 'reports/' || point_id || '/' || direction || '/' || replace(replace(strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || printf('%03d', CAST(floor(epoch_us(ts) / 1000) % 1000 AS INTEGER)) || 'Z', ':', '-'), '.', '-') || '.json' AS key FROM fx_reports")
def _(d):
    return d.fx_reports.select("event_id", names.report_key(F.col("point_id"), F.col("direction"), F.col("ts")).alias("key"))


# ---------------------------------------------------------------- filters


@query("filter_id_range", r"SELECT object_id, path, TRY_CAST(regexp_extract(regexp_extract(path, '[^/]*$'), '^(\d+)', 1) AS INTEGER) AS num FROM fx_objects WHERE TRY_CAST(regexp_extract(regexp_extract(path, '[^/]*$'), '^(\d+)', 1) AS INTEGER) BETWEEN 100 AND 400")
def _(d):
    return fl.filter_id_range(d.fx_objects, 50, 400, start=100)


POLYGON = [(40.961, 29.041), (40.969, 29.042), (40.967, 29.049), (40.964, 29.045), (40.962, 29.048)]


def crossings() -> str:
    terms = []
    for (a, b), (c, e) in zip(POLYGON, [*POLYGON[1:], POLYGON[0]], strict=True):
        terms.append(f"(CASE WHEN ({b}::DOUBLE > longitude) <> ({e}::DOUBLE > longitude) AND latitude < ({c - a!r}::DOUBLE) * (longitude - {b}::DOUBLE) / ({e - b!r}::DOUBLE) + {a}::DOUBLE THEN 1 ELSE 0 END)")
    return " + ".join(terms)


@query("filter_area_polygon", f"SELECT point_id, latitude, longitude FROM fx_points WHERE ({crossings()}) % 2 = 1")
def _(d):
    return fl.filter_area_polygon(d.fx_points, POLYGON).select("point_id", "latitude", "longitude")


@query("filter_area_bbox", "SELECT point_id FROM fx_points WHERE latitude BETWEEN 40.962::DOUBLE AND 40.966::DOUBLE AND longitude BETWEEN 29.042::DOUBLE AND 29.047::DOUBLE")
def _(d):
    return fl.filter_area_bbox(d.fx_points, 40.966, 40.962, 29.047, 29.042).select("point_id")


@query("filter_area_radius", "SELECT point_id FROM fx_points WHERE 2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin((radians(latitude) - radians(40.965::DOUBLE)) / 2), 2) + cos(radians(latitude)) * cos(radians(40.965::DOUBLE)) * pow(sin(radians(longitude - 29.045::DOUBLE) / 2), 2))) <= 300")
def _(d):
    return fl.filter_area_radius(d.fx_points, 40.965, 29.045, 300.0).select("point_id")


@query("filter_direction", f"WITH {PARSED} SELECT object_id, direction FROM p WHERE direction IN ('forward', 'backward')")
def _(d):
    return fl.filter_direction(parsed(d)).select("object_id", "direction")


@query("filter_confidence", "SELECT image_id, idx, CAST(confidence AS DOUBLE) AS confidence FROM fx_detections WHERE confidence > 0.5")
def _(d):
    return fl.filter_confidence(d.fx_detections).select("image_id", "idx", F.col("confidence").cast("double").alias("confidence"))


@query("filter_min_length", "SELECT edge_id, length, CAST(row_number() OVER (ORDER BY edge_id) - 1 AS BIGINT) AS segment_id FROM fx_edges WHERE length >= 50")
def _(d):
    return fl.filter_min_length(d.fx_edges, 50.0, "edge_id", "segment_id").select("edge_id", "length", "segment_id")


@query("filter_path_allowlist", r"SELECT object_id, regexp_replace(path, '/(\d+)-', '/\1/') AS path FROM fx_objects WHERE regexp_matches(path, '/00\d-')")
def _(d):
    foldered = d.fx_objects.withColumn("path", F.regexp_replace("path", r"/(\d+)-", "/$1/"))
    heads = d.spark.range(10).select(F.concat(F.lit("streetview/polygon_4v/20240101T000000Z/00"), F.col("id").cast("string")).alias("prefix"))
    return fl.filter_path_allowlist(foldered, heads)


@query("search_points", "SELECT point_id FROM (SELECT DISTINCT point_id FROM fx_reports) WHERE contains(point_id, '1') ORDER BY point_id LIMIT 20")
def _(d):
    return fl.search_points(d.fx_reports, " 1 ")


@query("filter_report_valid", "SELECT event_id, point_id, trim(description) AS description FROM fx_reports WHERE length(trim(description)) > 0")
def _(d):
    return fl.filter_report_valid(d.fx_reports)[0].select("event_id", "point_id", "description")


MERGED_LABELS = """l0 AS (SELECT *, max(y1) OVER (PARTITION BY image_id, label, x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM fx_label_runs),
l1 AS (SELECT *, sum(CASE WHEN pm IS NULL OR y0 > pm + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, label, x ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS g FROM l0),
lm AS (SELECT image_id, label, x, min(y0) AS y0, max(y1) AS y1 FROM l1 GROUP BY image_id, label, x, g)"""


@query("quality_gate", f"""WITH {MERGED_LABELS},
g AS (SELECT image_id, coalesce(sum(CASE WHEN label = 'sidewalk' THEN y1 - y0 + 1 END), 0) AS sw, coalesce(sum(CASE WHEN label = 'road' THEN y1 - y0 + 1 END), 0) AS road,
  count(DISTINCT CASE WHEN label = 'sidewalk' AND x >= 256 AND x < 384 THEN x END) AS cols FROM lm GROUP BY image_id),
q AS (SELECT image_id, CASE WHEN sw / 307200.0 < 0.02 THEN 'Q:sw_area_small' WHEN road / 307200.0 < 0.01 THEN 'Q:road_area_small' WHEN cols / 128.0 < 0.3 THEN 'Q:midline_coverage_low' ELSE '' END AS reason FROM g)
SELECT image_id, reason = '' AS ok, reason FROM q""")
def _(d):
    from ..operators.cloud import merge_label_runs

    return fl.quality_gate(merge_label_runs(d.fx_label_runs), 640, 480)


@query("availability_gate", "SELECT point_id FROM fx_points WHERE status = 'OK'")
def _(d):
    return fl.availability_gate(d.fx_points).select("point_id")


