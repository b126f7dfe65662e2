"""Queries: joins, aggregations, windows, sets and orders over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import detect, evaluate, graph, resolve, runs, sampling
from ..operators.raster import assign_obstacles
from .base import query
from .queries_names import JOINED, PARSED, parsed

# ---------------------------------------------------------------- joins


@query("join_images_masks", f"WITH {PARSED}, i AS (SELECT DISTINCT CAST(point_id AS BIGINT) AS image_id, direction FROM p) SELECT i.image_id, i.direction, m.mask_key, m.r, m.c0, m.c1 FROM i JOIN fx_mask_runs m USING (image_id) WHERE i.image_id IN (SELECT image_id FROM fx_mask_runs WHERE class_name = 'sidewalk')")
def _(d):
    images = parsed(d).select(F.col("point_id").cast("bigint").cast("string").alias("coordinate_folder"), "direction").distinct()
    dirs = images.select("coordinate_folder", "direction")
    masks = d.fx_mask_runs.withColumn("coordinate_folder", F.col("image_id").cast("string")).join(dirs, "coordinate_folder")
    out, _ = resolve.join_images_masks(images, masks)
    return out.select("image_id", "direction", "mask_key", "r", "c0", "c1")


def manifest(d):
    return d.fx_points.select("segment_id", "point_id", "point_type").withColumn("direction", F.lit("forward"))


@query("join_point_type", f"WITH {PARSED} SELECT p.object_id, coalesce(m.point_type, 'street') AS point_type FROM p LEFT JOIN fx_points m ON CAST(p.segment_id AS INTEGER) = m.segment_id AND CAST(p.point_id AS INTEGER) = m.point_id AND p.direction = 'forward'")
def _(d):
    return resolve.join_point_type(parsed(d), manifest(d)).select("object_id", "point_type")


@query("cross_camera_views", "SELECT point_id, direction, ((bearing + o) % 360 + 360) % 360 AS heading, pitch FROM fx_points, (VALUES ('forward', 0.0::DOUBLE, -10.0::DOUBLE), ('backward', 180.0::DOUBLE, -10.0::DOUBLE), ('left', -90.0::DOUBLE, -40.0::DOUBLE), ('right', 90.0::DOUBLE, -40.0::DOUBLE)) v(direction, o, pitch)")
def _(d):
    return sampling.cross_camera_views(d.fx_points.select("point_id", "bearing")).select("point_id", "direction", "heading", "pitch")


@query("join_pano_metadata", "SELECT p.point_id, CASE WHEN m.status = 'OK' THEN 'covered' ELSE 'no_coverage' END AS coverage, CASE WHEN m.status = 'OK' THEN m.pano_id ELSE '' END AS pano_id, CASE WHEN m.status = 'OK' THEN coalesce(m.latitude + 0.0001::DOUBLE, p.latitude) ELSE p.latitude END AS pano_lat FROM fx_points p LEFT JOIN (SELECT * FROM fx_points WHERE point_id % 4 <> 1) m USING (point_id)")
def _(d):
    meta = d.fx_points.where("point_id % 4 <> 1").select("point_id", "status", "pano_id", (F.col("latitude") + 0.0001).alias("pano_lat"), F.col("longitude").alias("pano_lng"), F.lit(None).cast("string").alias("date"))
    return resolve.join_pano_metadata(d.fx_points.select("point_id", "latitude", "longitude"), meta).select("point_id", "coverage", "pano_id", "pano_lat")


FOLDERS = f"""{PARSED}, f AS (SELECT DISTINCT CAST(CAST(point_id AS INTEGER) % 300 AS VARCHAR) AS point_id, direction, CAST(CAST(point_id AS INTEGER) % 300 AS VARCHAR) || '_' || lat || '_' || lon AS folder, CAST(lat AS DOUBLE) AS la, CAST(lon AS DOUBLE) AS lo FROM p),
t AS (SELECT point_id AS target_id, CAST(point_id % 400 AS VARCHAR) AS point_id, 'forward' AS direction, latitude AS lat, longitude AS lon FROM fx_points)"""


@query("resolve_nearest_folder", f"WITH {FOLDERS} SELECT target_id, coalesce(folder, point_id || '_unknown_unknown') AS folder, folder IS NOT NULL AS found FROM (SELECT t.target_id, t.point_id, f.folder, row_number() OVER (PARTITION BY t.target_id ORDER BY pow(f.la - t.lat, 2) + pow(f.lo - t.lon, 2), f.folder) AS rn FROM t LEFT JOIN f USING (point_id, direction)) WHERE rn = 1")
def _(d):
    p = parsed(d).withColumn("pid", (F.col("point_id").cast("int") % 300).cast("string"))
    folders = p.select(F.col("pid").alias("point_id"), "direction", names.coordinate_folder(F.col("pid"), F.col("lat"), F.col("lon")).alias("folder"))
    targets = d.fx_points.select(F.col("point_id").alias("target_id"), (F.col("point_id") % 400).cast("string").alias("point_id"), F.lit("forward").alias("direction"), F.lit(None).cast("string").alias("preferred"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return resolve.resolve_nearest_folder(targets, folders)


@query("resolve_run_alias", "SELECT path, 'streetview/polygon_4v/20240101T000000Z_rerun/' || regexp_extract(path, '[^/]*$') AS alias FROM fx_objects WHERE object_id % 3 = 1")
def _(d):
    again = d.fx_objects.where("object_id % 3 = 1")
    objects = again.select(F.replace("path", F.lit("000000Z/"), F.lit("000000Z_rerun/")).alias("path")).union(again.select(F.replace("path", F.lit("000000Z/"), F.lit("000000Z_re/")).alias("path")))
    return resolve.resolve_run_alias(d.fx_objects.select("path"), objects)


SPANS = "s AS (SELECT image_id, mask_key, class_name, min(c0) AS lo, max(c1) AS hi FROM fx_mask_runs GROUP BY ALL)"
ASSIGN = f"""{SPANS}, pr AS (SELECT o.image_id, o.mask_key AS obstacle_key, w.mask_key AS sidewalk_key, CASE WHEN (o.lo + o.hi) / 2.0 BETWEEN w.lo AND w.hi THEN 0.0::DOUBLE ELSE CAST(least(abs((o.lo + o.hi) / 2.0 - w.lo), abs((o.lo + o.hi) / 2.0 - w.hi)) AS DOUBLE) END AS dist
  FROM s o JOIN s w ON o.image_id = w.image_id AND w.class_name = 'sidewalk' AND o.class_name NOT IN ('sidewalk', 'road')),
a AS (SELECT image_id, obstacle_key, sidewalk_key, dist FROM (SELECT *, row_number() OVER (PARTITION BY image_id, obstacle_key ORDER BY dist, sidewalk_key) AS rn FROM pr) WHERE rn = 1)"""


@query("assign_obstacles", f"WITH {ASSIGN} SELECT * FROM a")
def _(d):
    return assign_obstacles(d.fx_mask_runs)


@query("add_road_layers", f"WITH {ASSIGN} SELECT image_id, sidewalk_key, obstacle_key AS layer_key FROM a UNION SELECT w.image_id, w.mask_key, r.mask_key FROM (SELECT DISTINCT image_id, mask_key FROM fx_mask_runs WHERE class_name = 'sidewalk') w JOIN (SELECT DISTINCT image_id, mask_key FROM fx_mask_runs WHERE class_name = 'road') r USING (image_id)")
def _(d):
    from ..operators.raster import add_road_layers

    return add_road_layers(assign_obstacles(d.fx_mask_runs), d.fx_mask_runs)


@query("join_predictions_truth", f"WITH {JOINED} SELECT id, predicted_width, central_width, abs_error FROM j")
def _(d):
    return evaluate.join_predictions_truth(d.fx_predictions, d.fx_truth)


VERTICES = "SELECT u AS segment_id, CAST(row_number() OVER (PARTITION BY u ORDER BY edge_id) - 1 AS INTEGER) AS pos, CAST(v % 100 AS DOUBLE) * 10 AS x, length AS y FROM fx_edges"


@query("linear_reference", f"""WITH v AS ({VERTICES}), l AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY segment_id ORDER BY pos)),
g AS (SELECT *, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS leg FROM l WHERE x2 IS NOT NULL),
c AS (SELECT *, coalesce(sum(leg) OVER (PARTITION BY segment_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum, lead(pos) OVER (PARTITION BY segment_id ORDER BY pos) IS NULL AS fin FROM g)
SELECT segment_id, dd AS distance, round(x + least(CASE WHEN leg > 0 THEN (dd - cum) / leg ELSE 0 END, 1) * (x2 - x), 6) AS x, round(y + least(CASE WHEN leg > 0 THEN (dd - cum) / leg ELSE 0 END, 1) * (y2 - y), 6) AS y FROM c, (VALUES (0.0::DOUBLE), (5.5::DOUBLE), (40.0::DOUBLE)) t(dd) WHERE dd >= cum AND (dd < cum + leg OR fin)""")
def _(d):
    from pyspark.sql import Window as W

    v = d.fx_edges.select(F.col("u").alias("segment_id"), (F.row_number().over(W.partitionBy("u").orderBy("edge_id")) - 1).alias("pos"), ((F.col("v") % 100).cast("double") * 10).alias("x"), F.col("length").alias("y"))
    dist = v.select("segment_id").distinct().withColumn("distance", F.explode(F.array(F.lit(0.0), F.lit(5.5), F.lit(40.0))))
    return sampling.linear_reference(v, dist).select("segment_id", "distance", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# ---------------------------------------------------------------- runs

MERGED = """r0 AS (SELECT image_id, mask_key, class_name, r, c0, c1, max(c1) OVER (PARTITION BY image_id, mask_key, r ORDER BY c0, c1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM fx_mask_runs),
r1 AS (SELECT *, sum(CASE WHEN pm IS NULL OR c0 > pm + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, mask_key, r ORDER BY c0, c1 ROWS UNBOUNDED PRECEDING) AS g FROM r0),
mr AS (SELECT image_id, mask_key, class_name, r, min(c0) AS c0, max(c1) AS c1 FROM r1 GROUP BY image_id, mask_key, class_name, r, g)"""


@query("merge_runs", f"WITH {MERGED} SELECT image_id, mask_key, r, c0, c1 FROM mr")
def _(d):
    return runs.merge_runs(d.fx_mask_runs, ["image_id", "mask_key", "r"])


@query("runs_from_flags", "WITH f AS (SELECT segment_id, point_id, status = 'OK' AS ok, point_id - row_number() OVER (PARTITION BY segment_id % 7 ORDER BY point_id) AS i FROM (SELECT segment_id % 7 AS segment_id, point_id, status FROM fx_points) WHERE true), o AS (SELECT segment_id, point_id, point_id // 7 AS pos FROM f WHERE ok), k AS (SELECT segment_id, pos, pos - row_number() OVER (PARTITION BY segment_id ORDER BY pos) AS i FROM (SELECT DISTINCT segment_id, pos FROM o)) SELECT segment_id, min(pos) AS run_start, max(pos) + 1 AS run_end FROM k GROUP BY segment_id, i")
def _(d):
    flags = d.fx_points.groupBy((F.col("segment_id") % 7).alias("segment_id"), F.floor(F.col("point_id") / 7).alias("pos")).agg(F.max(F.col("status") == "OK").alias("ok"))
    return runs.runs_from_flags(flags, ["segment_id"], "pos", "ok")


@query("usable_sidewalk", f"""WITH {ASSIGN}, w AS (SELECT image_id, mask_key AS sidewalk_key, r, generate_series AS c FROM (SELECT DISTINCT * FROM fx_mask_runs WHERE class_name = 'sidewalk'), generate_series(c0, c1)),
b AS (SELECT DISTINCT a.image_id, a.sidewalk_key, m.r, generate_series AS c FROM fx_mask_runs m JOIN a ON m.image_id = a.image_id AND m.mask_key = a.obstacle_key, generate_series(m.c0, m.c1))
SELECT image_id, sidewalk_key, count(*) AS usable_px FROM (SELECT DISTINCT * FROM w EXCEPT SELECT * FROM b) GROUP BY ALL""")
def _(d):
    return runs.usable_sidewalk(d.fx_mask_runs, assign_obstacles(d.fx_mask_runs))[1]


@query("silhouette_layers", """WITH z AS (SELECT image_id, r, generate_series AS c, max(CASE class_name WHEN 'sidewalk' THEN 0 WHEN 'road' THEN 1 WHEN 'tree' THEN 2 ELSE 3 END) AS k FROM fx_mask_runs, generate_series(c0, c1) GROUP BY ALL)
SELECT image_id, CASE k WHEN 0 THEN 'sidewalk' WHEN 1 THEN 'road' WHEN 2 THEN 'tree' ELSE 'car' END AS layer, count(*) AS px FROM z GROUP BY ALL""")
def _(d):
    order = F.when(F.col("class_name") == "sidewalk", 0).when(F.col("class_name") == "road", 1).when(F.col("class_name") == "tree", 2).otherwise(3)
    out = runs.silhouette_layers(d.fx_mask_runs.select("image_id", "r", "c0", "c1", F.col("class_name").alias("layer"), order.alias("draw_order")))
    return out.groupBy("image_id", "layer").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("px"))


@query("mask_area", f"WITH {MERGED} SELECT image_id, mask_key, CAST(sum(c1 - c0 + 1) AS BIGINT) AS mask_px, round(CAST(sum(c1 - c0 + 1) AS DOUBLE) / 307200, 6) AS area_ratio FROM mr GROUP BY ALL")
def _(d):
    return runs.mask_area(d.fx_mask_runs, 640, 480)


UNION = """u0 AS (SELECT image_id, r, c0, c1, max(c1) OVER (PARTITION BY image_id, r ORDER BY c0, c1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM fx_mask_runs),
u1 AS (SELECT *, sum(CASE WHEN pm IS NULL OR c0 > pm + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, r ORDER BY c0, c1 ROWS UNBOUNDED PRECEDING) AS g FROM u0),
un AS (SELECT image_id, CAST(sum(w) AS BIGINT) AS union_px FROM (SELECT image_id, r, g, max(c1) - min(c0) + 1 AS w FROM u1 GROUP BY image_id, r, g) GROUP BY image_id)"""


@query("mask_union_area", f"WITH {UNION} SELECT image_id, union_px FROM un")
def _(d):
    return runs.mask_union_area(d.fx_mask_runs)


# ---------------------------------------------------------------- detections

SUMMARY = f"""{UNION}, dt AS (SELECT image_id, round(CAST(confidence AS DOUBLE), 4) AS c FROM fx_detections WHERE confidence > 0.5),
ds AS (SELECT image_id, count(*) AS n, round(avg(c), 4) AS mean, min(c) AS lo, max(c) AS hi FROM dt GROUP BY image_id),
im AS (SELECT DISTINCT image_id FROM fx_detections),
sm AS (SELECT im.image_id, coalesce(n, 0) AS detection_count, mean AS mean_confidence, lo AS min_confidence, hi AS max_confidence, coalesce(union_px, 0) AS total_segmented_pixels, round(CAST(coalesce(union_px, 0) AS DOUBLE) / 307200, 6) AS total_segmented_ratio
  FROM im LEFT JOIN ds USING (image_id) LEFT JOIN un USING (image_id))"""


def summary(d):
    """The figures that ``batch_summary`` has in its SQL: pixels of all masks of an image."""
    return detect.detection_summary(d.fx_detections, d.fx_detections, runs.mask_union_area(d.fx_mask_runs), 640, 480, nested=False)


#: The mask of an image that its detection ``idx`` has.
MASK_OF = "CASE WHEN idx <= 3 THEN 'sidewalk_0' WHEN idx = 4 THEN 'sidewalk_1' WHEN idx = 5 THEN 'tree_0' WHEN idx = 6 THEN 'car_0' ELSE 'road_0' END"


def exact(x: str, n: int) -> str:
    """A double as its digits say, rounded half up, with n decimals."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 15)), {n}) AS DECIMAL(18, {n}))"


DOCUMENTS = f"""dt AS (SELECT image_id, idx, {MASK_OF} AS mask_key, round(CAST(confidence AS DOUBLE), 4) AS c, mask_pixels,
  {exact("x1", 1)} AS x1, {exact("y1", 1)} AS y1, {exact("x2", 1)} AS x2, {exact("y2", 1)} AS y2, {exact("x2 - x1", 1)} AS w, {exact("y2 - y1", 1)} AS h, {exact("CAST(mask_pixels AS DOUBLE) / 307200", 6)} AS ratio FROM fx_detections WHERE confidence > 0.5),
ds AS (SELECT image_id, count(*) AS n, round(avg(c), 4) AS mean, min(c) AS lo, max(c) AS hi, string_agg(concat_ws(',', idx, CAST(c AS DECIMAL(18, 4)), x1, y1, x2, y2, w, h, mask_pixels, ratio), ';' ORDER BY idx, c, x1, y1, x2, y2, w, h, mask_pixels, ratio) AS detections FROM dt GROUP BY image_id),
k0 AS (SELECT DISTINCT image_id, r, c0, c1 FROM fx_mask_runs JOIN dt USING (image_id, mask_key)),
k1 AS (SELECT *, max(c1) OVER (PARTITION BY image_id, r ORDER BY c0, c1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM k0),
k2 AS (SELECT *, sum(CASE WHEN pm IS NULL OR c0 > pm + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, r ORDER BY c0, c1 ROWS UNBOUNDED PRECEDING) AS g FROM k1),
kn AS (SELECT image_id, CAST(sum(w) AS BIGINT) AS union_px FROM (SELECT image_id, r, g, max(c1) - min(c0) + 1 AS w FROM k2 GROUP BY image_id, r, g) GROUP BY image_id),
im AS (SELECT o_orderkey AS image_id FROM orders UNION SELECT image_id FROM fx_detections)"""


@query("detection_summary", f"""WITH {DOCUMENTS} SELECT im.image_id, coalesce(n, 0) AS detection_count, mean AS mean_confidence, lo AS min_confidence, hi AS max_confidence, coalesce(detections, '') AS detections,
  coalesce(union_px, 0) AS total_segmented_pixels, round(CAST(coalesce(union_px, 0) AS DOUBLE) / 307200, 6) AS total_segmented_ratio FROM im LEFT JOIN ds USING (image_id) LEFT JOIN kn USING (image_id)""")
def _(d):
    """Documents of all orders' images, also of those without detections; the detections as text, for engines differ in nested columns."""
    found = d.fx_detections.withColumn("mask_key", F.expr(MASK_OF))
    images = d.orders.select(F.col("o_orderkey").alias("image_id")).union(d.fx_detections.select("image_id"))
    docs = detect.detection_summary(found, images, runs.mask_union_area(detect.detected_masks(found, d.fx_mask_runs)), 640, 480)

    def text(x):
        box = [x["bbox_xyxy"][i].cast("decimal(18,1)") for i in range(4)]
        return F.concat_ws(",", *[c.cast("string") for c in (x["index"], x["confidence"].cast("decimal(18,4)"), *box, x["bbox_width"].cast("decimal(18,1)"), x["bbox_height"].cast("decimal(18,1)"), x["mask_pixels"], x["mask_area_ratio"].cast("decimal(18,6)"))])

    return docs.withColumn("detections", F.array_join(F.transform("detections", text), ";"))


@query("batch_summary", f"WITH {SUMMARY} SELECT count(*) AS images_processed, 0 AS images_skipped, CAST(sum(detection_count) AS BIGINT) AS total_detections, round(avg(detection_count), 2) AS avg_detections, round(avg(total_segmented_ratio), 6) AS avg_ratio, round(min(total_segmented_ratio), 6) AS min_ratio, round(max(total_segmented_ratio), 6) AS max_ratio FROM sm")
def _(d):
    return detect.batch_summary(summary(d))


# ---------------------------------------------------------------- evaluation


@query("width_metrics", f"WITH {JOINED}, e AS (SELECT predicted_width - central_width AS e FROM j WHERE central_width IS NOT NULL) SELECT count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(quantile_cont(abs(e), 0.5), 6) AS median_ae, round(avg(e), 6) AS bias, round(stddev_pop(e), 6) AS error_std, round(avg(CASE WHEN abs(e) < 0.25 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS pct_25cm, round(avg(CASE WHEN abs(e) < 0.5 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS pct_50cm FROM e")
def _(d):
    m = evaluate.width_metrics(evaluate.join_predictions_truth(d.fx_predictions, d.fx_truth))
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns if c != "n"])


@query("skip_breakdown", "SELECT reason, count(*) AS n, split_part(reason, ':', 1) AS class FROM fx_skips GROUP BY reason ORDER BY n DESC, reason")
def _(d):
    return evaluate.skip_breakdown(d.fx_skips)


@query("worst_predictions", f"WITH {JOINED} SELECT id, round(predicted_width, 6) AS predicted_width, central_width, round(abs_error, 6) AS abs_error FROM j WHERE abs_error IS NOT NULL ORDER BY j.abs_error DESC, id LIMIT 10")
def _(d):
    w = evaluate.worst_predictions(evaluate.join_predictions_truth(d.fx_predictions, d.fx_truth))
    return w.select("id", F.round("predicted_width", 6).alias("predicted_width"), "central_width", F.round("abs_error", 6).alias("abs_error"))


# ---------------------------------------------------------------- viewer tables

FILES = "CASE point_id % 7 WHEN 0 THEN 'width_profile.png' WHEN 1 THEN 'width_overlay.png' WHEN 2 THEN 'obstacles.png' WHEN 3 THEN 'footprint.png' WHEN 4 THEN 'width_metadata.json' WHEN 5 THEN 'footprint_metadata.json' ELSE 'notes.txt' END"


@query("artifact_pivot", f"WITH a AS (SELECT segment_id, {FILES} AS f FROM fx_points), b AS (SELECT 'seg_' || segment_id AS segment, f, 'out/seg_' || segment_id || '/' || f AS path FROM a WHERE f <> 'notes.txt') SELECT segment, max(path) FILTER (f = 'width_profile.png') AS width_profile, max(path) FILTER (f = 'width_overlay.png') AS width_overlay, max(path) FILTER (f = 'obstacles.png') AS obstacles, max(path) FILTER (f = 'footprint.png') AS footprint, max(path) FILTER (f = 'width_metadata.json') AS width_metadata, max(path) FILTER (f = 'footprint_metadata.json') AS footprint_metadata FROM b GROUP BY segment ORDER BY segment")
def _(d):
    rows = d.fx_points.select(F.concat(F.lit("out/seg_"), "segment_id", F.lit("/"), F.expr(FILES)).alias("path"))
    return resolve.artifact_pivot(rows)


@query("run_counters", "SELECT count(*) AS total_points, count(DISTINCT segment_id) AS segments, count(*) FILTER (point_type = 'junction') AS junction_points, count(DISTINCT pano_id) AS unique_panos, count(pano_id) - count(DISTINCT pano_id) AS duplicates, count(*) FILTER (status = 'OK') AS uploaded, count(*) FILTER (status <> 'OK') AS failed, count(DISTINCT point_id % 4) AS directions FROM fx_points")
def _(d):
    m = d.fx_points.select(F.when(F.col("status") == "OK", "uploaded").otherwise("fetch_failed").alias("status"), (F.col("point_id") % 4).alias("direction"))
    return resolve.run_counters(d.fx_points, m)


def lines(d):
    return d.fx_points.select((F.col("point_id") % 900).cast("string").alias("point_id"), F.col("point_id").alias("line_no"), F.element_at(F.array(*map(F.lit, resolve.CANONICAL)), ((F.col("point_id") % 4) + 1).cast("int")).alias("direction"), "latitude", "longitude", "pano_id", F.concat(F.lit("gs://b/"), "point_id").alias("gcs_uri"), F.col("bearing").alias("heading"))


@query("point_map", "WITH m AS (SELECT CAST(point_id % 900 AS VARCHAR) AS pid, point_id AS n, CASE point_id % 4 WHEN 0 THEN 'forward' WHEN 1 THEN 'right' WHEN 2 THEN 'backward' ELSE 'left' END AS direction, latitude, longitude, pano_id FROM fx_points), f AS (SELECT pid, arg_min(latitude, n) AS latitude, arg_min(longitude, n) AS longitude, arg_min(pano_id, n) AS pano_id FROM m GROUP BY pid), l AS (SELECT pid, direction, 'gs://b/' || max(n) AS uri FROM m GROUP BY pid, direction) SELECT f.pid AS point_id, latitude, longitude, pano_id, string_agg(direction || '=' || uri, ';' ORDER BY direction) AS directions FROM f JOIN l USING (pid) GROUP BY ALL")
def _(d):
    m = resolve.point_map(lines(d))
    text = F.array_join(F.transform(F.map_entries("directions"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["uri"])), ";")
    return m.select("point_id", "latitude", "longitude", "pano_id", text.alias("directions"))


@query("available_directions", "SELECT CAST(point_id % 900 AS VARCHAR) AS point_id, string_agg(DISTINCT CASE point_id % 4 WHEN 0 THEN '0forward' WHEN 1 THEN '1right' WHEN 2 THEN '2backward' ELSE '3left' END, ',' ORDER BY CASE point_id % 4 WHEN 0 THEN '0forward' WHEN 1 THEN '1right' WHEN 2 THEN '2backward' ELSE '3left' END) AS directions FROM fx_points GROUP BY point_id % 900")
def _(d):
    a = resolve.available_directions(resolve.point_map(lines(d)))
    place = F.array(*map(F.lit, resolve.CANONICAL))
    return a.select("point_id", F.array_join(F.transform("directions", lambda x: F.concat((F.array_position(place, x) - 1).cast("string"), x)), ",").alias("directions"))


@query("visual_batch_summary", "SELECT count(*) AS images_processed, count(*) FILTER (image_id % 9 = 0) AS junction_stubs, count(DISTINCT image_id % 50) AS segments, CAST(sum(k) AS BIGINT) AS obstacles FROM (SELECT image_id, count(DISTINCT mask_key) FILTER (class_name NOT IN ('sidewalk', 'road')) AS k FROM fx_mask_runs GROUP BY image_id)")
def _(d):
    types = F.collect_set(F.when(~F.col("class_name").isin("sidewalk", "road"), F.col("mask_key")))
    images = d.fx_mask_runs.groupBy("image_id").agg(types.alias("obstacle_types")).withColumns({"segment_id": F.col("image_id") % 50, "status": F.when(F.col("image_id") % 9 == 0, "junction_stub").otherwise("ok")})
    return resolve.visual_batch_summary(images)[1]


# ---------------------------------------------------------------- sets and orders


@query("nth_longest_edge", "SELECT edge_id, u, v, length FROM fx_edges ORDER BY length DESC, edge_id LIMIT 1 OFFSET 3")
def _(d):
    return sampling.nth_longest_edge(d.fx_edges, 3).select("edge_id", "u", "v", "length")


@query("pano_dedup", "SELECT pano_id, min(point_id) AS point_id FROM fx_points GROUP BY pano_id")
def _(d):
    return resolve.pano_dedup(d.fx_points, "point_id").select("pano_id", "point_id")


@query("distinct_folders", f"WITH {PARSED} SELECT DISTINCT point_id || '_' || lat || '_' || lon AS coordinate_folder FROM p WHERE direction = 'left'")
def _(d):
    return resolve.distinct_folders(parsed(d), "left")


@query("union_frames", "SELECT point_id, latitude, CAST(NULL AS VARCHAR) AS note FROM fx_points WHERE status = 'OK' UNION ALL SELECT point_id, latitude, 'none' AS note FROM fx_points WHERE status <> 'OK'")
def _(d):
    a = d.fx_points.where("status = 'OK'").select("point_id", "latitude")
    b = d.fx_points.where("status <> 'OK'").select("point_id", "latitude", F.lit("none").alias("note"))
    return resolve.union_frames(a, b, a.limit(0))


@query("uncovered_edges", "SELECT edge_id FROM fx_edges WHERE u % 5 <> 2")
def _(d):
    return graph.uncovered_edges(d.fx_edges, d.fx_edges.where("u % 5 = 2").select("edge_id")).select("edge_id")


@query("dedupe_parallel_edges", "SELECT edge_id, u, v, length FROM (SELECT *, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY length DESC, edge_id) AS rn FROM fx_edges) WHERE rn = 1")
def _(d):
    return graph.dedupe_parallel_edges(d.fx_edges).select("edge_id", "u", "v", "length")


@query("node_degree", "WITH e AS (SELECT u, v FROM (SELECT *, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY length DESC, edge_id) AS rn FROM fx_edges) WHERE rn = 1) SELECT node, count(*) AS degree, count(*) >= 3 AS is_junction, count(*) <> 2 AS is_terminal FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e) GROUP BY node")
def _(d):
    return graph.node_degree(graph.dedupe_parallel_edges(d.fx_edges))


# ---------------------------------------------------------------- windows

NEXT = "degrees(atan2(sin(radians(lo2) - radians(longitude)) * cos(radians(la2)), cos(radians(latitude)) * sin(radians(la2)) - sin(radians(latitude)) * cos(radians(la2)) * cos(radians(lo2) - radians(longitude))))"


@query("bearing_along", f"WITH n AS (SELECT segment_id, point_id, latitude, longitude, lead(latitude) OVER w AS la2, lead(longitude) OVER w AS lo2 FROM fx_points WINDOW w AS (PARTITION BY segment_id ORDER BY point_id)), b AS (SELECT *, {NEXT} AS b0 FROM n), c AS (SELECT *, b0 - 360.0::DOUBLE * floor(b0 / 360.0::DOUBLE) AS b FROM b) SELECT segment_id, point_id, round(coalesce(b, lag(b) OVER (PARTITION BY segment_id ORDER BY point_id), 0), 4) AS bearing FROM c")
def _(d):
    rows = sampling.bearing_along(d.fx_points.drop("bearing"), "segment_id", "point_id")
    return rows.select("segment_id", "point_id", F.round("bearing", 4).alias("bearing"))


@query("sequence_ids", "SELECT segment_id, point_id, printf('%06d', row_number() OVER (ORDER BY segment_id, point_id) - 1) AS seq FROM fx_points")
def _(d):
    return graph.sequence_ids(d.fx_points.select("segment_id", "point_id"), ["segment_id", "point_id"], pattern="%06d")


@query("endpoint_flags", "SELECT segment_id, point_id, CASE WHEN (point_id = min(point_id) OVER w AND segment_id % 2 = 0) OR (point_id = max(point_id) OVER w AND segment_id % 3 = 0) THEN 'junction' ELSE 'street' END AS point_type FROM fx_points WINDOW w AS (PARTITION BY segment_id)")
def _(d):
    segs = d.fx_points.select("segment_id").distinct().withColumns({"start_is_junction": F.col("segment_id") % 2 == 0, "end_is_junction": F.col("segment_id") % 3 == 0})
    return sampling.endpoint_flags(d.fx_points.drop("point_type"), segs, "point_id").select("segment_id", "point_id", "point_type")


@query("sample_along", "SELECT edge_id AS segment_id, dd AS distance FROM (SELECT edge_id, unnest(list_distinct(list_append(list_filter([k * 15.0::DOUBLE FOR k IN generate_series(0, 40)], lambda x: x < length), length))) AS dd FROM fx_edges)")
def _(d):
    return sampling.sample_along(d.fx_edges.withColumn("segment_id", F.col("edge_id")), 15.0)


@query("canonical_direction", "SELECT edge_id, CASE WHEN u % 7 > v % 5 OR (u % 7 = v % 5 AND u > v) THEN v % 5 ELSE u % 7 END AS start_lat, u % 7 > v % 5 OR (u % 7 = v % 5 AND u > v) AS reversed, CASE WHEN u % 7 > v % 5 OR (u % 7 = v % 5 AND u > v) THEN v % 2 = 0 ELSE u % 2 = 0 END AS start_is_junction FROM fx_edges")
def _(d):
    s = d.fx_edges.select("edge_id", (F.col("u") % 7).alias("start_lat"), F.col("u").alias("start_lon"), (F.col("v") % 5).alias("end_lat"), F.col("v").alias("end_lon"), (F.col("u") % 2 == 0).alias("start_is_junction"), (F.col("v") % 2 == 0).alias("end_is_junction"))
    return graph.canonical_direction(s).select("edge_id", "start_lat", "reversed", "start_is_junction")


@query("build_manifest", """WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pano_id ORDER BY point_id) AS rn FROM fx_points WHERE status = 'OK') WHERE rn = 1),
v AS (SELECT p.segment_id, p.point_id, p.point_type, d.direction, p.point_id % 6 <> 0 AS ok, p.latitude, ((p.bearing + d.o) % 360 + 360) % 360 AS heading FROM p, (VALUES ('forward', 0.0::DOUBLE), ('backward', 180.0::DOUBLE), ('left', -90.0::DOUBLE), ('right', 90.0::DOUBLE)) d(direction, o))
SELECT segment_id, point_id, point_type, direction, CASE WHEN ok THEN 'uploaded' ELSE 'fetch_failed' END AS status, CASE WHEN ok THEN latitude END AS latitude, CASE WHEN ok THEN heading END AS heading FROM v""")
def _(d):
    points = d.fx_points.withColumns({"idx": F.col("point_id"), "pano_lat": F.col("latitude"), "pano_lng": F.col("longitude")})
    fetched = d.fx_points.select("point_id", F.explode(F.array(*map(F.lit, resolve.CANONICAL))).alias("direction"), (F.col("point_id") % 6 != 0).alias("ok"))
    return sampling.build_manifest(points, fetched).select("segment_id", "point_id", "point_type", "direction", "status", "latitude", "heading")


