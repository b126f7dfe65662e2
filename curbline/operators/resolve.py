"""Joins of images, manifests, panoramas and artifact folders; viewer tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import parse_folder
from .filters import first_per

ARTIFACTS = ("width_profile.png", "width_overlay.png", "obstacles.png", "footprint.png", "width_metadata.json", "footprint_metadata.json")
ALT_ARTIFACTS = ("alt_width_metadata.json", "alt_overlay.png", "alt_profile.png", "alt_scene.png")
#: Folders of one point and direction that a row holds.
PLACES = 1000
CANONICAL = ("forward", "right", "backward", "left")


def join_images_masks(images: DataFrame, mask_runs: DataFrame, version: int = 2) -> tuple[DataFrame, DataFrame]:
    """Images with their mask runs by (coordinate_folder, direction), and status rows of images without a sidewalk
    mask (none in the older form)."""
    keys = ["coordinate_folder", "direction"]
    walks = mask_runs.where("class_name = 'sidewalk'").select(*keys).distinct()
    good = images.join(walks, keys, "left_semi")
    status = images.join(walks, keys, "left_anti").withColumn("status", F.lit("no_sidewalk_mask"))
    return good.join(mask_runs, keys), status if version == 2 else status.limit(0)


def join_point_type(images: DataFrame, manifest: DataFrame, strict_text_keys: bool = False) -> DataFrame:
    """point_type of each image by (segment, point, direction), street where the manifest lacks it. Ids are compared
    as integers; ``strict_text_keys`` compares their text."""
    def norm(c: str):
        return F.col(c).cast("string") if strict_text_keys else F.col(c).cast("string").try_cast("int")

    kinds = manifest.select(norm("segment_id").alias("_s"), norm("point_id").alias("_p"), F.col("direction").alias("_d"), F.col("point_type").alias("_t")).dropDuplicates(["_s", "_p", "_d"])
    rows = images.join(kinds, (norm("segment_id") == F.col("_s")) & (norm("point_id") == F.col("_p")) & (F.col("direction") == F.col("_d")), "left")
    return rows.withColumn("point_type", F.coalesce("_t", F.lit("street"))).drop("_s", "_p", "_d", "_t")


def join_pano_metadata(points: DataFrame, pano_meta: DataFrame) -> DataFrame:
    """Points with panorama data: place falls back to the point, ids and dates to '', missing is no_coverage."""
    meta = pano_meta.select("point_id", F.col("status").alias("_st"), F.col("pano_id").alias("_id"), F.col("pano_lat").alias("_la"), F.col("pano_lng").alias("_lo"), F.col("date").alias("_dt"))
    rows = points.join(meta, "point_id", "left")
    ok = F.coalesce(F.col("_st") == "OK", F.lit(False))
    return rows.select(
        *points.columns, F.when(ok, "covered").otherwise("no_coverage").alias("coverage"), F.when(ok, F.coalesce("_id", F.lit(""))).otherwise("").alias("pano_id"),
        F.when(ok, F.coalesce("_la", "latitude")).otherwise(F.col("latitude")).alias("pano_lat"), F.when(ok, F.coalesce("_lo", "longitude")).otherwise(F.col("longitude")).alias("pano_lng"), F.when(ok, F.coalesce("_dt", F.lit(""))).otherwise("").alias("date"),
    )


def resolve_nearest_folder(targets: DataFrame, folders: DataFrame) -> DataFrame:
    """The folder for each target (target_id, point_id, direction, preferred, lat, lon): its own if it has artifacts,
    else the nearest of the same point and direction by squared degrees, lexicographic on ties or without a place,
    else the preferred name or ``{point}_unknown_unknown``. folders: folder, point_id, direction."""
    place = ["point_id", "direction"]
    at = folders.select(*place, "folder").distinct().withColumn("_part", F.floor((F.row_number().over(W.partitionBy(*place).orderBy("folder")) - 1) / PLACES).cast("int"))
    at = at.withColumn("_g", parse_folder(F.col("folder"))).groupBy(*place, "_part").agg(F.collect_list(F.struct("folder", "_g")).alias("_all")).drop("_part")
    rows = targets.join(at, place, "left")

    def found(f: Column) -> Column:
        d = F.pow(f["_g"]["lat"] - F.col("lat"), 2) + F.pow(f["_g"]["lon"] - F.col("lon"), 2)
        dist = F.when(F.col("lat").isNull() | F.col("lon").isNull(), 0.0).otherwise(F.coalesce(d, F.lit(float("inf"))))
        other = F.coalesce(f["folder"] != F.col("preferred"), F.lit(True))
        return F.struct(other.alias("other"), dist.alias("dist"), f["folder"].alias("folder"))

    # a target meets its folders as an array, so only its least struct is a row; it is sorted once, where all of a target's rows are
    best = rows.select("target_id", "preferred", "point_id", F.array_min(F.transform("_all", found)).alias("_b")).repartition("target_id")
    best = best.groupBy("target_id").agg(F.min("_b").alias("_b"), F.any_value("preferred").alias("preferred"), F.any_value("point_id").alias("point_id")).select("target_id", "preferred", "point_id", "_b.folder")
    return best.select("target_id", F.coalesce("folder", "preferred", F.concat(F.col("point_id").cast("string"), F.lit("_unknown_unknown"))).alias("folder"), F.col("folder").isNotNull().alias("found"))


def resolve_run_alias(missing: DataFrame, objects: DataFrame) -> DataFrame:
    """For missing paths ``root/polygon/run/base``: the object of another run folder of the polygon whose name extends
    the run, longest name first, then lexicographic. A path that is missing several times has a row each time."""
    def parts(df: DataFrame, p: str) -> DataFrame:
        s = F.split("path", "/")
        return df.select(F.col("path").alias(f"{p}path"), *[c for c in df.columns if c != "path"], F.try_element_at(s, F.lit(1)).alias(f"{p}root"), F.try_element_at(s, F.lit(2)).alias(f"{p}poly"), F.try_element_at(s, F.lit(3)).alias(f"{p}run"), F.element_at(s, -1).alias(f"{p}base"))

    a = parts(missing.groupBy("path").agg(F.count("*").alias("times")), "m").where(F.col("mrun").rlike(r"^\d{8}T\d{6}Z"))
    b = parts(objects.select("path").distinct(), "o")
    rows = a.join(b, (F.col("mroot") == F.col("oroot")) & (F.col("mpoly") == F.col("opoly")) & (F.col("mbase") == F.col("obase")) & F.col("orun").startswith(F.col("mrun")) & (F.col("orun") != F.col("mrun")))
    return first_per(rows, ["mpath"], [F.desc(F.length("orun")), F.col("orun"), F.col("opath")]).select(F.col("mpath").alias("path"), F.col("opath").alias("alias"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col")


def pano_dedup(points: DataFrame, order: str = "idx") -> DataFrame:
    """The first point of every panorama."""
    return first_per(points, ["pano_id"], [F.col(order)])


def distinct_folders(objects: DataFrame, direction: str) -> DataFrame:
    return objects.where(F.col("direction") == direction).select("coordinate_folder").distinct()


def union_frames(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; missing columns are null. Empty frames keep the schema."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def artifact_pivot(objects: DataFrame, names: tuple[str, ...] = ARTIFACTS) -> DataFrame:
    """One row per segment folder with the path of each artifact (null: none), in order of the folder."""
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    rows = objects.select(F.col("path"), folder.alias("segment"), F.element_at(F.split("path", "/"), -1).alias("file")).where(F.col("file").isin(*names))
    return rows.groupBy("segment").agg(*[F.max(F.when(F.col("file") == n, F.col("path"))).alias(n.split(".")[0]) for n in names]).orderBy("segment")


def run_counters(points: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row of a run's counts."""
    a = points.agg(
        F.count("*").alias("total_points"), F.countDistinct("segment_id").alias("segments"), F.count_if(F.col("point_type") == "junction").alias("junction_points"),
        F.countDistinct("pano_id").alias("unique_panos"), (F.count("pano_id") - F.countDistinct("pano_id")).alias("duplicates"),
    )
    b = manifest.agg(F.count_if(F.col("status") == "uploaded").alias("uploaded"), F.count_if(F.col("status") != "uploaded").alias("failed"), F.countDistinct("direction").alias("directions"))
    return a.crossJoin(b)  # one row each


def point_map(manifest: DataFrame) -> DataFrame:
    """Points with the attributes of their first row and a map of direction to (uri, heading) of the last row each.
    manifest has line_no."""
    first = manifest.groupBy("point_id").agg(F.min_by(F.struct("latitude", "longitude", "pano_id"), "line_no").alias("a"))
    last = manifest.groupBy("point_id", "direction").agg(F.max_by(F.struct(F.col("gcs_uri").alias("uri"), "heading"), "line_no").alias("v"))
    maps = last.groupBy("point_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("direction", "v")))).alias("directions"))
    return first.join(maps, "point_id").select("point_id", "a.*", "directions")


def available_directions(points: DataFrame) -> DataFrame:
    """Directions of each point in canonical order."""
    return points.select("point_id", F.array_intersect(F.array(*map(F.lit, CANONICAL)), F.map_keys("directions")).alias("directions"))


def visual_batch_summary(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row of each image with its obstacles, and one row of counts: images, junction stubs, distinct segments, obstacles.
    images: image_id, segment_id, status, obstacle_types (array)."""
    details = images.select("image_id", "segment_id", "status", F.coalesce(F.size("obstacle_types"), F.lit(0)).alias("obstacles"), F.array_sort(F.array_distinct("obstacle_types")).alias("types"))
    counts = details.agg(
        F.count("*").alias("images_processed"), F.count_if(F.col("status") == "junction_stub").alias("junction_stubs"), F.countDistinct("segment_id").alias("segments"), F.coalesce(F.sum("obstacles"), F.lit(0)).alias("obstacles")
    )
    return details, counts


def last_duplicate(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
