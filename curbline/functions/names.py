"""Image, mask and object names as Column expressions. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIRECTIONS = ("forward", "backward", "left", "right")
_TAIL = r"_[-\d.]+_[-\d.]+_[\d.]+\.\w+$"
_ANY = "_(forward|backward|left|right)" + _TAIL
#: Names without a segment, with one, and with one but only forward or backward.
PLAIN, SEGMENTED, SEGMENTED_TWO_WAY = r"^\d+" + _ANY, r"^\d+-\d+" + _ANY, r"^\d+-\d+_(forward|backward)" + _TAIL
GRAMMARS = {"any": r"^(\d+-)?\d+" + _ANY, "plain": PLAIN, "two_way": f"({SEGMENTED_TWO_WAY})|({PLAIN})"}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parse_image_name(path: Column, grammar: str = "any") -> Column:
    """segment_id, point_id, direction, lat, lon, heading and coordinate_folder as text; null if nothing matches.

    grammar: "any" reads both name forms, "plain" only names without a segment, "two_way" takes segmented
    names with forward and backward only."""
    name = basename(path)
    ok, parts = name.rlike(GRAMMARS[grammar]), F.split(name, "_")  # one match; the fields are cut at the marks
    head = F.split(parts[0], "-")
    heading = F.regexp_replace(parts[4], r"\.\w+$", "")
    point = F.element_at(head, -1)
    return F.when(ok, F.struct(
        F.when(F.size(head) == 2, head[0]).otherwise("0").alias("segment_id"), point.alias("point_id"), parts[1].alias("direction"), parts[2].alias("lat"), parts[3].alias("lon"), heading.alias("heading"),
        F.concat_ws("_", point, parts[2], parts[3]).alias("coordinate_folder"),
    ))


def numeric_prefix(path: Column, id_key: str = "leading") -> Column:
    """Leading integer of the basename, or the parsed point id."""
    if id_key == "point":
        return parse_image_name(path)["point_id"].try_cast("int")
    return F.regexp_extract(basename(path), r"^(\d+)", 1).try_cast("int")


def coordinate_folder(point_id: Column, lat: Column, lon: Column) -> Column:
    return F.concat_ws("_", point_id.cast("string"), lat.cast("string"), lon.cast("string"))


def parse_folder(folder: Column) -> Column:
    """lat and lon of ``{point}_{lat}_{lon}``; null unless both are finite numbers."""
    lat = F.regexp_extract(folder, r"_([^_]*)_([^_]*)$", 1).try_cast("double")
    lon = F.regexp_extract(folder, r"_([^_]*)_([^_]*)$", 2).try_cast("double")
    good = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) < float("inf")) & (F.abs(lon) < float("inf"))
    return F.when(good, F.struct(lat.alias("lat"), lon.alias("lon")))


def slug(text: Column) -> Column:
    return F.replace(F.lower(F.trim(F.split_part(text, F.lit(","), F.lit(1)))), F.lit(" "), F.lit("_"))


def safe_prompt(prompt: Column) -> Column:
    return F.btrim(F.regexp_replace(prompt, r"(?U)[^\w\-]+", "_"), F.lit("_"))


def strip_uri(uri: Column, bucket: str | None = None) -> Column:
    """Object key of ``gs://bucket/key``; other text is unchanged. With a bucket, another one is an error."""
    key = F.regexp_replace(uri, r"^gs://[^/]+/", "")
    if bucket is None:
        return key
    other = uri.startswith("gs://") & ~uri.startswith(f"gs://{bucket}/")
    return F.when(other, F.raise_error(F.concat(F.lit("not in the bucket: "), uri))).otherwise(key)


def capture_key(segment: Column | None, point: Column, direction: Column, lat: Column, lon: Column, heading: Column) -> Column:
    """Object name of a captured image; without a segment the older form."""
    tail = F.concat(F.lit("_"), direction, F.lit("_"), lat.cast("string"), F.lit("_"), lon.cast("string"), F.lit("_"), F.format_string("%.1f", heading), F.lit(".jpg"))
    if segment is None:
        return F.concat(F.format_string("%04d", point), tail)
    return F.concat(F.format_string("%03d-%04d", segment, point), tail)


def mask_key(path: Column, version: int = 2) -> Column:
    """Key of a mask file from its path: class, folder two above, index; the older form has class and index."""
    parts = F.split(path, "/")
    index = F.regexp_replace(F.regexp_replace(F.element_at(parts, -1), r"\.\w+$", ""), "^mask_", "")
    if version == 1:
        return F.when(F.size(parts) >= 2, F.concat_ws("_", F.element_at(parts, -2), index))
    return F.when(F.size(parts) >= 3, F.concat_ws("_", F.element_at(parts, -2), F.try_element_at(parts, F.lit(-3)), index))


def mask_class_flags(key: Column, class_name: Column, tree_tokens: tuple[str, ...] = ("tree",), version: int = 2) -> Column:
    side = class_name.contains("sidewalk") if version == 2 else class_name == "sidewalk"
    road = F.split_part(F.lower(key), F.lit("_"), F.lit(1)) == "road"
    tree = F.exists(F.array(*map(F.lit, tree_tokens)), lambda x: F.lower(key).contains(x))
    return F.struct(side.alias("is_sidewalk"), road.alias("is_road"), tree.alias("is_tree"))


def street_name_norm(names: Column) -> Column:
    return F.coalesce(F.when(F.size(names) > 0, F.array_join(names, ", ")), F.lit("unknown"))


def report_key(point_id: Column, direction: Column, ts: Column) -> Column:
    stamp = F.translate(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), ":.", "--")
    return F.concat(F.lit("reports/"), point_id, F.lit("/"), direction, F.lit("/"), stamp, F.lit(".json"))
