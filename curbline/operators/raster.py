"""Mask rasters as run rows: edges, fits, widths, rectified strips, footprints.

mask_runs: image_id, mask_key, class_name, r, c0, c1. All grouping is by image and mask, so images spread."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import pinhole_width_cm
from ..scratch import settle
from .filters import first_per
from .graph import component_bbox, raster_components
from .runs import changes, in_whole_groups, merge_runs, merged_runs

KEYS = ["image_id", "mask_key"]


@dataclass(frozen=True)
class WidthConfig:
    width_px: int = 640
    height_px: int = 480
    border_margin: int = 3
    camera_height_m: float = 1.8
    min_horizon_dist: int = 20
    iqr_k: float = 1.5
    exclude_extrapolated: bool = True


def row_edges(mask_runs: DataFrame, width_px: int, border_margin: int = 3) -> DataFrame:
    """First and last column of each mask row; valid if neither is near the image's border."""
    rows = mask_runs.groupBy(*KEYS, "r").agg(F.min("c0").alias("lo"), F.max("c1").alias("hi"))
    left, right = F.col("lo") < border_margin, F.col("hi") >= width_px - border_margin
    return rows.select(*KEYS, "r", F.col("lo").cast("double").alias("left"), F.col("hi").cast("double").alias("right"), left.alias("clip_left"), right.alias("clip_right"), (~left & ~right).alias("valid"))


def edge_fit(edges: DataFrame) -> DataFrame:
    """Least-squares lines of both edges over the rows, from valid rows (null below two)."""
    ok = edges.where("valid")
    return ok.groupBy(*KEYS).agg(
        F.regr_slope("left", "r").alias("a_left"), F.regr_intercept("left", "r").alias("b_left"),
        F.regr_slope("right", "r").alias("a_right"), F.regr_intercept("right", "r").alias("b_right"), F.count("*").alias("n_valid"),
    )


def extrapolate_edges(edges: DataFrame, fit: DataFrame) -> DataFrame:
    """Rows at the border take the fitted value on the clipped side, if two valid rows gave a fit."""
    rows = edges.join(fit, KEYS, "left")
    fitted = F.coalesce(F.col("n_valid") >= 2, F.lit(False)) & (F.col("clip_left") | F.col("clip_right"))
    left = F.when(fitted & F.col("clip_left"), F.col("a_left") * F.col("r") + F.col("b_left")).otherwise(F.col("left"))
    right = F.when(fitted & F.col("clip_right"), F.col("a_right") * F.col("r") + F.col("b_right")).otherwise(F.col("right"))
    return rows.select(*KEYS, "r", left.alias("left"), right.alias("right"), (F.col("valid") | fitted).alias("valid"), fitted.alias("extrapolated"))


def width_steps(height_px: int, min_horizon_dist: int = 20, exclude_extrapolated: bool = True) -> list:
    below = F.col("r") > height_px / 2
    far = below & (F.col("r") > height_px / 2 + min_horizon_dist)
    return [below, far, far & ~F.col("extrapolated") if exclude_extrapolated else far]


def filter_width_rows(edges: DataFrame, height_px: int, min_horizon_dist: int = 20, exclude_extrapolated: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows used for widths, and how many each step drops."""
    valid = edges.where("valid")
    below, far, used = width_steps(height_px, min_horizon_dist, exclude_extrapolated)
    counters = valid.groupBy(*KEYS).agg(
        F.count("*").alias("rows_valid"), F.count_if(~below).alias("above_horizon"), F.count_if(below & ~far).alias("near_horizon"), F.count_if(far & ~used).alias("extrapolated_rows")
    )
    return valid.where(used), counters


def iqr_fence(df: DataFrame, keys: list[str], value: str, k: float = 1.5) -> DataFrame:
    """Adds lo, hi and inlier: within k interquartile ranges of the quartiles, ends included."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).over(W.partitionBy(*keys))
    rows = df.withColumn("_q", q)
    spread = F.col("_q")[1] - F.col("_q")[0]
    return rows.withColumns({"lo": F.col("_q")[0] - k * spread, "hi": F.col("_q")[1] + k * spread}).withColumn("inlier", F.col(value).between(F.col("lo"), F.col("hi"))).drop("_q")


def mad_filter(df: DataFrame, keys: list[str], value: str, k: float = 3.0) -> DataFrame:
    """Adds inlier: closer to the median than k scaled median absolute deviations."""
    w = W.partitionBy(*keys)
    rows = df.withColumn("_m", F.percentile(value, F.lit(0.5)).over(w)).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    rows = rows.withColumn("_mad", F.percentile("_d", F.lit(0.5)).over(w))
    return rows.withColumn("inlier", F.col("_d") < k * (F.col("_mad") * 1.4826 + 1e-6)).drop("_m", "_d", "_mad")


def width_rows(mask_runs: DataFrame, cfg: WidthConfig = WidthConfig(), class_name: str = "sidewalk") -> tuple[DataFrame, DataFrame]:
    """Width of each usable row with its fence, and the drop counters of each mask."""
    edges = row_edges(mask_runs.where(F.col("class_name") == class_name), cfg.width_px, cfg.border_margin)
    whole = extrapolate_edges(edges, edge_fit(edges))
    used, counters = filter_width_rows(whole, cfg.height_px, cfg.min_horizon_dist, cfg.exclude_extrapolated)
    widths = used.withColumn("width_cm", pinhole_width_cm(F.col("left"), F.col("right"), F.col("r"), cfg.height_px, cfg.camera_height_m))
    return iqr_fence(widths, KEYS, "width_cm", cfg.iqr_k), counters


def width_stats(rows: DataFrame, counters: DataFrame) -> DataFrame:
    """Median, mean, population deviation, range and counters; masks without inliers are absent."""
    ok = rows.where("inlier").groupBy(*KEYS).agg(
        F.percentile("width_cm", F.lit(0.5)).alias("median_cm"), F.avg("width_cm").alias("mean_cm"), F.stddev_pop("width_cm").alias("std_cm"), F.min("width_cm").alias("min_cm"), F.max("width_cm").alias("max_cm"), F.count("*").alias("rows_used")
    )
    outliers = rows.groupBy(*KEYS).agg(F.count_if(~F.col("inlier")).alias("outlier_rows"))
    return ok.join(counters, KEYS).join(outliers, KEYS)


def estimate_width(mask_runs: DataFrame, images: DataFrame | None = None, cfg: WidthConfig = WidthConfig()) -> DataFrame:
    """Width statistics of every sidewalk mask with a status; with images, those without a sidewalk mask too."""
    rows, counters = width_rows(mask_runs, cfg)
    stats = width_stats(rows, counters)
    masks = mask_runs.where("class_name = 'sidewalk'").select(*KEYS).distinct()
    valid = counters.select(*KEYS, F.lit(True).alias("_valid"))
    out = masks.join(stats, KEYS, "left").join(valid, KEYS, "left")
    out = out.withColumn("status", F.when(F.col("_valid").isNull(), "no_valid_edges").when(F.col("rows_used").isNull(), "no_rows").otherwise("ok")).drop("_valid")
    if images is not None:
        none = images.select("image_id").distinct().join(masks, "image_id", "left_anti").withColumn("status", F.lit("no_sidewalk_mask"))
        out = out.unionByName(none, allowMissingColumns=True)
    return out


def width_profile(rows: DataFrame) -> DataFrame:
    """Rows with width, fence, inlier flag, the inliers' median, and the sample rows at a quarter, half and three quarters."""
    w = W.partitionBy(*KEYS)
    n, rank = F.count("*").over(w), F.row_number().over(w.orderBy("r"))
    median = F.percentile(F.when(F.col("inlier"), F.col("width_cm")), F.lit(0.5)).over(w)
    sampled = (rank == F.floor(n * 0.25) + 1) | (rank == F.floor(n * 0.5) + 1) | (rank == F.floor(n * 0.75) + 1)
    return rows.select(*KEYS, "r", "width_cm", "inlier", "lo", "hi", median.alias("median_cm"), sampled.alias("sampled"))


# ---------------------------------------------------------------- rectification


def row_scale_cumsum(fit: DataFrame, span: DataFrame, height_px: int, max_stretch: float = 6.0) -> DataFrame:
    """Stretch of each image row and its running sum (zero at row 0). span: first and last valid row of a mask."""
    slope = F.col("a_left") - F.col("a_right")
    vy = F.when((F.col("n_valid") >= 2) & (F.abs(slope) > 1e-6), F.try_divide(F.col("b_right") - F.col("b_left"), slope)).otherwise(-1e8)
    rows = fit.join(span, KEYS).withColumn("vy", vy)
    rows = rows.withColumns({"_first": F.when(F.col("n_valid") >= 2, F.col("first_row")).otherwise(0), "_last": F.when(F.col("n_valid") >= 2, F.col("last_row")).otherwise(height_px - 1)})
    rows = rows.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(height_px - 1))))
    ratio = F.try_divide(F.abs(F.col("_last") - F.col("vy")), F.abs(F.col("r") - F.col("vy")))
    scale = F.when(~F.col("r").between(F.col("_first"), F.col("_last")), 1.0).when(F.col("r") == F.col("vy"), max_stretch).otherwise(F.least(ratio * ratio, F.lit(max_stretch)))
    order = W.partitionBy(*KEYS).orderBy("r")
    rows = rows.withColumn("scale", scale).withColumn("_c", F.sum("scale").over(order.rowsBetween(W.unboundedPreceding, 0)))
    cum = F.col("_c") - F.first("_c").over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.select(*KEYS, "r", "scale", cum.alias("cum"))


def rectify_row_map(scale: DataFrame, height_px: int) -> DataFrame:
    """Output row to fractional source row: each source row makes the output rows that fall in its stretch."""
    order = W.partitionBy(*KEYS).orderBy("r")
    rows = scale.withColumns({"nxt": F.lead("cum").over(order), "_end": F.last("cum").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    first = F.ceil(F.round("cum", 9)).cast("int")  # a row that begins at a whole output row does so whatever the sum's last digits
    last = F.coalesce(F.ceil(F.round("nxt", 9)).cast("int") - 1, F.ceil(F.round("_end", 9)).cast("int"))
    rows = rows.withColumns({"_a": first, "_b": last}).where("_a <= _b").withColumn("out_r", F.explode(F.sequence("_a", "_b")))
    src = F.col("r") + F.coalesce(F.try_divide(F.col("out_r") - F.col("cum"), F.col("nxt") - F.col("cum")), F.lit(0.0))
    return rows.select(*KEYS, "out_r", F.least(src, F.lit(height_px - 1.0)).alias("src_r"))


def strip_rows(line: dict, height_px: int, max_stretch: float = 6.0) -> tuple[np.ndarray, ...]:
    """Of one mask's strip: output row, nearest source row, left edge and source columns per output column. The same as
    row_scale_cumsum and rectify_row_map say, as a prefix sum over an array."""
    r = np.arange(height_px)
    first, last, vy = 0, height_px - 1, -1e8
    if line["n_valid"] >= 2:
        first, last = line["first_row"], line["last_row"]
        slope = line["a_left"] - line["a_right"]
        if abs(slope) > 1e-6:
            vy = (line["b_right"] - line["b_left"]) / slope
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = abs(last - vy) / np.abs(r - vy)
    scale = np.where((r < first) | (r > last), 1.0, np.where(r == vy, max_stretch, np.minimum(ratio * ratio, max_stretch)))
    cum = np.cumsum(scale)
    cum -= cum[0]
    whole = np.ceil(np.floor(cum * 1e9 + 0.5) / 1e9).astype(np.int64)
    stop = np.append(whole[1:], whole[-1] + 1)  # the last row makes the last output row
    counts = np.maximum(stop - whole, 0)
    src = np.repeat(r, counts)
    out_r = np.repeat(whole, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    nxt = np.append(cum[1:], np.nan)
    part = np.divide(out_r - cum[src], nxt[src] - cum[src], out=np.zeros(len(src)), where=(nxt[src] - cum[src]) > 0)
    at = np.minimum(src + part, height_px - 1.0)
    if line["_n"] < 2:
        left, right = np.full(len(at), float(line["_l"])), np.full(len(at), float(line["_r"]))
    else:
        left, right = line["a_left"] * at + line["b_left"], line["a_right"] * at + line["b_right"]
    return out_r, np.rint(at).astype(np.int64), left, (right - left) / line["target_w"]


def rectify_masks(mask_runs: DataFrame, assignment: DataFrame, edges: DataFrame, fit: DataFrame | None, width_px: int, height_px: int, target_width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Sidewalks and their obstacles warped to straight strips, as runs; and each strip's target width and padding.

    edges: extrapolated edges; assignment: image_id, obstacle_key, sidewalk_key. Run ends map to the columns whose
    nearest source pixel lies in the run. A sidewalk's runs and those of its obstacles meet its one row of figures in a task, many
    sidewalks at a time, and strips' rows exist only there, as arrays."""
    ok = edges.where("valid")
    figures = [F.percentile(F.col("right") - F.col("left"), F.lit(0.5)).alias("_w"), F.min("r").alias("first_row"), F.max("r").alias("last_row"), F.count("*").alias("_n"), F.min_by("left", "r").alias("_l"), F.min_by("right", "r").alias("_r")]
    if fit is None:
        figures += [f("left", "r").alias(f"{n}_left") for n, f in (("a", F.regr_slope), ("b", F.regr_intercept))] + [f("right", "r").alias(f"{n}_right") for n, f in (("a", F.regr_slope), ("b", F.regr_intercept))] + [F.count("*").alias("n_valid")]
    lines = ok.groupBy(*KEYS).agg(*figures).where("_w >= 1").withColumn("target_w", F.greatest(F.lit(1), F.bround("_w").cast("int")) if target_width is None else F.lit(target_width))
    lines = settle((lines if fit is None else lines.join(fit, KEYS)).withColumn("pad", F.floor(F.col("target_w") * 0.3).cast("int")).withColumnRenamed("mask_key", "sidewalk_key"), "lines")
    keys = ["image_id", "sidewalk_key"]
    columns = [*keys, "mask_key", "class_name", "r", "c0", "c1"]
    own = mask_runs.where("class_name = 'sidewalk'").withColumn("sidewalk_key", F.col("mask_key")).select(*columns)
    other = mask_runs.join(assignment.select("image_id", F.col("obstacle_key").alias("mask_key"), "sidewalk_key"), ["image_id", "mask_key"]).select(*columns)
    kinds = {n: mask_runs.schema[n].dataType.simpleString() for n in ("image_id", "mask_key", "class_name")}
    figures = lines.select(*keys, F.struct(*[c for c in lines.columns if c not in keys]).alias("line"))

    def warp(table: pa.Table) -> pa.Table:
        strip = np.cumsum(changes(table, keys))  # of each row
        is_line = table["line"].is_valid().to_numpy()
        target_w, pad = np.zeros(len(strip) + 1, np.int64), np.zeros(len(strip) + 1, np.int64)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]
        for k, line in zip(strip[is_line].tolist(), table["line"].filter(pa.array(is_line)).to_pylist(), strict=True):
            rows, near, left, s = strip_rows(line, height_px)
            wide = np.flatnonzero(s > 0)  # rows whose edges cross have no columns
            order = wide[np.argsort(near[wide], kind="stable")]
            found.append((k * height_px + near[order], rows[order], left[order], s[order]))
            target_w[k], pad[k] = line["target_w"], line["pad"]
        near, rows, left, s = (np.concatenate(x) for x in zip(*found, strict=True))
        runs = table.filter(pa.array(~is_line))
        strip, mask = strip[~is_line], np.cumsum(changes(runs, [*keys, "mask_key"])) - 1
        first_of = np.searchsorted(mask, np.arange(mask[-1] + 1 if len(mask) else 0))
        r, c0, c1 = (runs[c].to_numpy().astype(np.int64) for c in ("r", "c0", "c1"))
        inside = (r >= 0) & (r < height_px)
        key, c0, c1 = merged_runs((mask * height_px + r)[inside], c0[inside], c1[inside])
        of = strip[first_of[key // height_px]]
        begin, end = (np.searchsorted(near, of * height_px + key % height_px, side) for side in ("left", "right"))
        n = end - begin
        run = np.repeat(np.arange(len(key)), n)
        at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shift, most = pad[of[run]], (target_w + 2 * pad - 1)[of[run]]
        o0 = np.maximum(np.ceil((c0[run] - 0.5 - left[at]) / s[at] + shift), 0).astype(np.int64)
        o1 = np.minimum(np.floor((c1[run] + 0.5 - left[at]) / s[at] + shift), most).astype(np.int64)
        some = o0 <= o1
        picked = runs.select([*keys, "mask_key", "class_name"]).take(pa.array(first_of[key[run] // height_px][some]))
        for name, v in (("out_r", rows[at]), ("o0", o0), ("o1", o1)):
            picked = picked.append_column(name, pa.array(v[some].astype(np.int32)))
        return picked

    rows = own.unionByName(other).unionByName(figures, allowMissingColumns=True)
    out = in_whole_groups(rows, keys, ["mask_key"], warp, f"image_id {kinds['image_id']}, sidewalk_key {kinds['mask_key']}, mask_key {kinds['mask_key']}, class_name {kinds['class_name']}, out_r int, o0 int, o1 int")
    return out, lines.select(*keys, "target_w", "pad", (F.col("target_w") + 2 * F.col("pad")).alias("out_width"))


# ---------------------------------------------------------------- obstacles


def assign_obstacles(mask_runs: DataFrame, version: int = 2) -> DataFrame:
    """Each obstacle's sidewalk: that whose column span holds the obstacle's middle or ends nearest to it, first on
    ties. Masks without pixels have no runs and so take no part."""
    spans = mask_runs.groupBy("image_id", "mask_key", "class_name").agg(F.min("c0").alias("lo"), F.max("c1").alias("hi"))
    walks = spans.where("class_name = 'sidewalk'").select("image_id", F.col("mask_key").alias("sidewalk_key"), F.col("lo").alias("wl"), F.col("hi").alias("wr"))
    obstacles = spans.where("class_name not in ('sidewalk', 'road')").select("image_id", F.col("mask_key").alias("obstacle_key"), ((F.col("lo") + F.col("hi")) / 2.0).alias("mid"))
    pairs = obstacles.join(walks, "image_id")  # masks of one image: a few
    dist = F.when(F.col("mid").between(F.col("wl"), F.col("wr")), 0.0).otherwise(F.least(F.abs(F.col("mid") - F.col("wl")), F.abs(F.col("mid") - F.col("wr"))).cast("double"))
    return first_per(pairs.withColumn("dist", dist), ["image_id", "obstacle_key"], [F.col("dist"), F.col("sidewalk_key")]).select("image_id", "obstacle_key", "sidewalk_key", "dist")


def add_road_layers(assignment: DataFrame, mask_runs: DataFrame) -> DataFrame:
    """Assigned obstacles and every road mask of the image, for each sidewalk that has obstacles or not."""
    walks = mask_runs.where("class_name = 'sidewalk'").select("image_id", F.col("mask_key").alias("sidewalk_key")).distinct()
    roads = mask_runs.where(F.split_part(F.lower("mask_key"), F.lit("_"), F.lit(1)) == "road").select("image_id", F.col("mask_key").alias("layer_key")).distinct()
    own = assignment.select("image_id", "sidewalk_key", F.col("obstacle_key").alias("layer_key"))
    return own.union(walks.join(roads, "image_id").select("image_id", "sidewalk_key", "layer_key")).distinct()


STRIP = ["image_id", "sidewalk_key", "mask_key"]


def estimate_footprint(rect_runs: DataFrame, rect_dims: DataFrame, tree_tokens: tuple[str, ...] = ("tree",), base: float = 0.15, trunk: float = 0.40, aspect: float = 1.0, max_h: int = 25) -> tuple[DataFrame, DataFrame]:
    """Ground rectangles under each component of the rectified obstacles: one row each, and their union as runs."""
    runs = rect_runs.where("class_name <> 'sidewalk'").select(*STRIP, F.col("out_r").alias("r"), F.col("o0").alias("c0"), F.col("o1").alias("c1"))
    tree = F.exists(F.array(*map(F.lit, tree_tokens)), lambda x: F.lower("mask_key").contains(x))
    comp = [*STRIP, "comp_id"]
    rows = raster_components(runs, STRIP).repartition(*comp).groupBy(*comp, "r").agg(F.min("c0").alias("a"), F.max("c1").alias("b"))  # one exchange for all that follows
    w = W.partitionBy(*comp)
    rows = rows.withColumns({"min_row": F.min("r").over(w), "max_row": F.max("r").over(w) + 1, "is_tree": tree})
    height = F.col("max_row") - F.col("min_row")
    scan = F.when(F.col("is_tree"), F.greatest(F.lit(1), F.floor(height * trunk).cast("int"))).otherwise(F.greatest(F.lit(3), F.floor(height * base).cast("int")))
    rows = rows.where(F.col("r") >= F.col("max_row") - F.least(scan, height))
    boxes = rows.groupBy(*comp, "min_row", "max_row", "is_tree").agg(F.percentile(F.col("b") - F.col("a") + 1, F.lit(0.5)).alias("w"), F.percentile((F.col("a") + F.col("b")) / 2.0, F.lit(0.5)).alias("mid"))
    prints = boxes.withColumn("height", height).join(rect_dims.select("image_id", "sidewalk_key", "out_width"), ["image_id", "sidewalk_key"])
    prints = prints.withColumn("fp_w", F.greatest(F.floor("w").cast("int"), F.lit(1)))
    prints = prints.withColumn("fp_h", F.least(F.greatest(F.lit(1), F.floor(F.col("fp_w") * aspect).cast("int")), F.col("height"), F.lit(max_h)))
    prints = prints.withColumn("fp_left", F.greatest(F.lit(0), F.floor(F.col("mid") - F.col("fp_w") / 2).cast("int")))
    prints = prints.withColumns({"fp_right": F.least(F.col("out_width"), F.col("fp_left") + F.col("fp_w")), "fp_top": F.greatest(F.col("min_row"), F.col("max_row") - F.col("fp_h"))})
    prints = settle(prints.select(*comp, "is_tree", "fp_left", "fp_top", "fp_right", F.col("max_row").alias("fp_bottom")), "prints")
    filled = prints.select(*STRIP, F.explode(F.sequence("fp_top", F.col("fp_bottom") - 1)).alias("r"), F.col("fp_left").alias("c0"), (F.col("fp_right") - 1).alias("c1")).where("c0 <= c1")
    return prints, merge_runs(filled, [*STRIP, "r"])


def footprint_metadata(rect_runs: DataFrame, footprint_runs: DataFrame, rect_dims: DataFrame, tree_tokens: tuple[str, ...] = ("tree",)) -> DataFrame:
    """One row per footprint region: type, method, box, areas and how much smaller it is than the silhouette."""
    full = rect_runs.groupBy(*STRIP, "class_name").agg(F.sum(F.col("o1") - F.col("o0") + 1).alias("full_silhouette_area_px"))
    boxes = component_bbox(raster_components(footprint_runs, STRIP), STRIP)
    tree = F.exists(F.array(*map(F.lit, tree_tokens)), lambda x: F.lower("mask_key").contains(x))
    rows = boxes.join(full, STRIP).join(rect_dims, ["image_id", "sidewalk_key"])
    return rows.select(
        *STRIP, F.col("class_name").alias("type"), F.when(tree, "trunk").otherwise("base").alias("method"), "min_col", "min_row", "max_col", "max_row",
        (F.col("max_col") - F.col("min_col")).alias("footprint_width_px"), F.col("height").alias("footprint_height_px"), F.col("area").alias("footprint_area_px"), "full_silhouette_area_px",
        F.round((1 - F.col("area") / F.greatest("full_silhouette_area_px", F.lit(1))) * 100, 1).alias("reduction_pct"), "target_w", "pad",
    )
