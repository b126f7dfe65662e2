"""Points along streets: sampling, linear reference, bearings, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import bearing, camera_heading, project_metric, unproject_wgs84, zone_of
from ..functions.names import capture_key
from ..scratch import settle
from .filters import filter_area_polygon, filter_min_length, first_per
from .graph import canonical_direction, chain_decompose, chain_geometry, dedupe_parallel_edges, node_degree, polyline_length, sequence_ids

INTERVAL_M, INTERVAL_M_V1 = 30.0, 15.0
#: Camera views of the newer and the older sampler: label, offset from the street's bearing, pitch.
VIEWS = [("forward", 0.0, -10.0), ("backward", 180.0, -10.0), ("left", -90.0, -40.0), ("right", 90.0, -40.0)]
VIEWS_V1 = [("forward", 0.0, 0.0), ("right", 90.0, 0.0), ("backward", 180.0, 0.0), ("left", 270.0, 0.0)]


def sample_along(segments: DataFrame, interval_m: float = INTERVAL_M) -> DataFrame:
    """segment_id and distances 0, i, 2i, ... below the length, and the length itself."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / interval_m).cast("int") - 1, F.lit(0)))
    inner = F.transform(steps, lambda k: k * F.lit(float(interval_m)))
    d = F.array_distinct(F.concat(F.filter(inner, lambda x: x < F.col("length")), F.array(F.col("length").cast("double"))))
    return segments.select("segment_id", F.explode(d).alias("distance"))


def linear_reference(vertices: DataFrame, distances: DataFrame) -> DataFrame:
    """x, y at a distance along a polyline. vertices: segment_id, pos, x, y; distances: segment_id, distance."""
    order = W.partitionBy("segment_id").orderBy("pos")
    legs = vertices.select("segment_id", "pos", "x", "y", F.lead("x").over(order).alias("x2"), F.lead("y").over(order).alias("y2")).where("x2 is not null")
    legs = legs.withColumn("leg", F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")))
    upto = F.coalesce(F.sum("leg").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    legs = legs.withColumns({"cum": upto, "_last": F.lead("pos").over(order).isNull()})
    both = distances.join(legs, "segment_id").where((F.col("distance") >= F.col("cum")) & ((F.col("distance") < F.col("cum") + F.col("leg")) | F.col("_last")))
    t = F.least(F.coalesce(F.try_divide(F.col("distance") - F.col("cum"), F.col("leg")), F.lit(0.0)), F.lit(1.0))
    return both.select("segment_id", "distance", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"))


def bearing_along(samples: DataFrame, key: str = "segment_id", order: str = "distance") -> DataFrame:
    """Bearing to the next point of the segment; the last point repeats the one before it."""
    w = W.partitionBy(key).orderBy(order)
    rows = samples.withColumns({"_lat": F.lead("latitude").over(w), "_lon": F.lead("longitude").over(w)})
    rows = rows.withColumn("_b", bearing(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon")))
    return rows.withColumn("bearing", F.coalesce("_b", F.lag("_b").over(w), F.lit(0.0))).drop("_lat", "_lon", "_b")


def endpoint_flags(samples: DataFrame, segments: DataFrame, order: str = "distance") -> DataFrame:
    """junction for a segment's first or last sample where that end is a junction, else street."""
    w = W.partitionBy("segment_id")
    rows = samples.join(segments.select("segment_id", "start_is_junction", "end_is_junction"), "segment_id")
    first, last = F.row_number().over(w.orderBy(order)) == 1, F.row_number().over(w.orderBy(F.desc(order))) == 1
    rows = rows.withColumns({"_f": first, "_l": last})
    kind = F.when((F.col("_f") & F.col("start_is_junction")) | (F.col("_l") & F.col("end_is_junction")), "junction").otherwise("street")
    return rows.withColumn("point_type", kind).drop("_f", "_l", "start_is_junction", "end_is_junction")


def cross_camera_views(points: DataFrame, views: list[tuple[str, float, float]] = VIEWS) -> DataFrame:
    """Each point with every view; views are literals of the plan, so nothing is joined."""
    structs = [F.struct(F.lit(v[0]).alias("direction"), F.lit(v[1]).alias("offset"), F.lit(v[2]).alias("pitch")) for v in views]
    rows = points.withColumn("_v", F.explode(F.array(*structs))).select(*points.columns, "_v.*")
    return rows.withColumn("heading", camera_heading(F.col("bearing"), F.col("offset")))


def metric_shapes(edges: DataFrame, zone: DataFrame) -> DataFrame:
    """edge_id, u and geometry in metres (x, y) of edges whose ``geometry`` is an array of lon, lat from u to v; ``zone`` is one row."""
    def place(p: Column) -> Column:
        return project_metric(p["lon"], p["lat"], F.col("zone"))

    return edges.crossJoin(F.broadcast(zone)).select("edge_id", "u", F.transform("geometry", place).alias("geometry"))


def segments_of(nodes: DataFrame, edges: DataFrame, min_m: float = 1.0, legacy_flags: bool = False) -> DataFrame:
    """Maximal chains as segments: segment_id, geometry (metric), length, junction flags, street name. Edges may have a ``geometry`` (an array
    of lon, lat from u to v, null where the edge is straight)."""
    simple = dedupe_parallel_edges(edges)
    degree = node_degree(simple)
    zone = nodes.agg(zone_of(F.avg("lon")).alias("zone"))  # one row
    metric = nodes.crossJoin(F.broadcast(zone)).withColumn("_p", project_metric(F.col("lon"), F.col("lat"), F.col("zone")))
    chains = settle(chain_decompose(simple), "chains")
    own = metric_shapes(simple, zone) if "geometry" in simple.columns else None
    shapes = chain_geometry(chains, metric.select("node_id", F.col("_p.x").alias("x"), F.col("_p.y").alias("y")), own)
    names = chains.join(simple.select("edge_id", "name"), "edge_id")
    heads = names.groupBy("chain_id").agg(F.min_by("u", "pos").alias("start_node"), F.max_by("v", "pos").alias("end_node"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("pos"))).alias("name"))
    kinds = degree.select(F.col("node").alias("start_node"), F.col("is_junction").alias("start_is_junction"))
    kinds2 = degree.select(F.col("node").alias("end_node"), F.col("is_junction").alias("end_is_junction"))
    place = nodes.select(F.col("node_id").alias("start_node"), F.col("lat").alias("start_lat"), F.col("lon").alias("start_lon"))
    place2 = nodes.select(F.col("node_id").alias("end_node"), F.col("lat").alias("end_lat"), F.col("lon").alias("end_lon"))
    out = shapes.join(heads, "chain_id").join(kinds, "start_node").join(kinds2, "end_node").join(place, "start_node").join(place2, "end_node")
    out = canonical_direction(out.withColumn("street_name", F.coalesce("name", F.lit("unknown"))), legacy_flags).crossJoin(F.broadcast(zone))
    return filter_min_length(out, min_m, "chain_id", "segment_id").select("segment_id", "street_name", "start_is_junction", "end_is_junction", "geometry", "length", "zone")


def points_on(segments: DataFrame, interval_m: float) -> DataFrame:
    """segment_id, distance, latitude, longitude and bearing of the samples of metric segments."""
    vertices = segments.select("segment_id", F.posexplode("geometry").alias("pos", "_g")).select("segment_id", "pos", F.col("_g.x").alias("x"), F.col("_g.y").alias("y"))
    at = linear_reference(vertices, sample_along(segments, interval_m)).join(segments.select("segment_id", "zone"), "segment_id")
    at = at.withColumn("_g", unproject_wgs84(F.col("x"), F.col("y"), F.col("zone"))).select("segment_id", "distance", F.col("_g.lat").alias("latitude"), F.col("_g.lon").alias("longitude"))
    return bearing_along(at)


def _rounded(points: DataFrame) -> list:
    return [F.round("latitude", 7).alias("latitude"), F.round("longitude", 7).alias("longitude"), F.round("bearing", 2).alias("bearing"), F.round("distance", 2).alias("distance_along_m")]


def sample_polygon(nodes: DataFrame, edges: DataFrame, vertices: list[tuple[float, float]], interval_m: float = INTERVAL_M) -> DataFrame:
    """Evenly spaced points on all segments of the streets inside a polygon."""
    inside = filter_area_polygon(nodes.withColumnsRenamed({"lat": "latitude", "lon": "longitude"}), vertices).select("node_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    ids = inside.select("node_id")
    kept = edges.join(ids.withColumnRenamed("node_id", "u"), "u", "left_semi").join(ids.withColumnRenamed("node_id", "v"), "v", "left_semi")
    segments = settle(segments_of(inside, kept), "segments")
    points = endpoint_flags(points_on(segments, interval_m), segments).join(segments.select("segment_id", "street_name"), "segment_id")
    points = settle(points, "points")
    numbered = sequence_ids(points, ["segment_id", "distance"], "point_id", pattern="%04d")
    return numbered.select("segment_id", "point_id", "point_type", *_rounded(numbered), "street_name")


def nth_longest_edge(edges: DataFrame, edge_index: int = 0) -> DataFrame:
    """The edge at a place by length, longest first; no such place is an error."""
    top = edges.orderBy(F.desc("length"), "edge_id").limit(edge_index + 1)
    ranked = top.withColumn("_rn", F.row_number().over(W.orderBy(F.desc("length"), "edge_id")) - 1).where(F.col("_rn") == edge_index).drop("_rn")
    found = ranked.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, F.raise_error(F.lit(f"no edge at {edge_index}"))).otherwise(F.lit(True)).alias("_ok"))
    return ranked.crossJoin(F.broadcast(found)).where("_ok").drop("_ok")


def sample_edges_v1(nodes: DataFrame, edges: DataFrame, interval_m: float = INTERVAL_M_V1, edge_index: int = 0, sample_all: bool = False) -> DataFrame:
    """Points on every edge by itself, or on the one at a place by length. nodes have metric x and y, and edges may have a ``geometry``
    (an array of x, y from u to v, null where the edge is straight). Edges without length give no points."""
    rows = edges if sample_all else nth_longest_edge(edges, edge_index)
    a = nodes.select(F.col("node_id").alias("u"), F.struct("x", "y").alias("_a"))
    b = nodes.select(F.col("node_id").alias("v"), F.struct("x", "y").alias("_b"))
    straight = F.array("_a", "_b")
    shape = F.when(F.size("geometry") >= 2, F.col("geometry")).otherwise(straight) if "geometry" in edges.columns else straight
    segs = rows.join(a, "u").join(b, "v").select(F.col("edge_id").alias("segment_id"), shape.alias("geometry")).withColumn("length", polyline_length(F.col("geometry"))).where("length > 0")
    vertices = segs.select("segment_id", F.posexplode("geometry").alias("pos", "_g")).select("segment_id", "pos", "_g.x", "_g.y")
    return linear_reference(vertices, sample_along(segs, interval_m))


def build_manifest(points: DataFrame, fetched: DataFrame, views: list[tuple[str, float, float]] = VIEWS, version: int = 2) -> DataFrame:
    """One row per point and view: uploaded, or fetch_failed with most columns null; the older sampler also lists
    points without coverage. points: segment_id, point_id, point_type, latitude, longitude, bearing, status, pano_id,
    pano_lat, pano_lng, idx; fetched: point_id, direction, ok."""
    covered = points.where("status = 'OK'")
    one = first_per(covered, ["pano_id"], [F.col("idx")])
    rows = cross_camera_views(one, views).join(fetched, ["point_id", "direction"], "left")
    up = F.coalesce("ok", F.lit(False))
    key = capture_key(F.col("segment_id") if version == 2 else None, F.col("point_id"), F.col("direction"), F.col("latitude"), F.col("longitude"), F.col("heading"))
    ragged = {"gcs_uri": F.concat(F.lit("gs://captures/"), key), "latitude": F.col("latitude"), "longitude": F.col("longitude"), "pano_id": F.col("pano_id"), "pano_lat": F.col("pano_lat"), "pano_lng": F.col("pano_lng"), "street_bearing": F.col("bearing"), "heading": F.col("heading"), "pitch": F.col("pitch")}
    out = rows.select("segment_id", "point_id", "point_type", "direction", F.when(up, "uploaded").otherwise("fetch_failed").alias("status"), *[F.when(up, c).alias(n) for n, c in ragged.items()])
    if version == 1:
        out = out.unionByName(points.where("status <> 'OK'").select("segment_id", "point_id", "point_type", F.lit("no_coverage").alias("status")), allowMissingColumns=True)
    return out
