"""Metric widths from dense points: cleaning, column edges, ground plane, scale, width across.

label_runs: image_id, label, x, y0, y1 (inclusive); cloud: image_id, yd, xd, x, y, z; pose: image_id, cx, cy, cz, fov."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import settle
from .graph import raster_components
from .raster import mad_filter
from .runs import best_run_per_column, merge_runs


def merge_label_runs(runs: DataFrame) -> DataFrame:
    """Union of each column's runs. Rows are dealt by image, so that what follows by image needs no other exchange."""
    dealt = runs.select("image_id", "label", "x", F.col("y0").alias("c0"), F.col("y1").alias("c1")).repartition("image_id")
    out = merge_runs(dealt, ["image_id", "label", "x"])
    return out.select("image_id", "label", "x", F.col("c0").alias("y0"), F.col("c1").alias("y1"))


def clean_label_mask(label_runs: DataFrame, width: int, height: int, label: str = "sidewalk") -> DataFrame:
    """Column runs of a label without small components, closed by a 3 x 3 square."""
    runs = label_runs.where(F.col("label") == label).select("image_id", F.col("x").alias("r"), F.col("y0").alias("c0"), F.col("y1").alias("c1"))
    # dealt by image once: what follows groups by image and more, and needs no other exchange
    comp = raster_components(runs, ["image_id"]).repartition("image_id")
    area = F.sum(F.col("c1") - F.col("c0") + 1).over(W.partitionBy("image_id", "comp_id"))
    kept = comp.withColumn("_area", area).where(F.col("_area") >= max(50, int(0.001 * width * height))).select("image_id", "r", "c0", "c1")
    grown = merge_runs(kept.select("image_id", F.explode(F.sequence(F.col("r") - 1, F.col("r") + 1)).alias("r"), (F.col("c0") - 1).alias("c0"), (F.col("c1") + 1).alias("c1")), ["image_id", "r"])
    # erosion: what three neighbouring columns share, less one pixel at both ends; columns outside the image count as set
    votes = grown.select("image_id", F.explode(F.sequence(F.col("r") - 1, F.col("r") + 1)).alias("r"), "c0", "c1")
    outside = (F.col("r") == 0).cast("int") + (F.col("r") == width - 1).cast("int")
    events = votes.select("image_id", "r", F.explode(F.array(F.struct(F.col("c0").alias("x"), F.lit(1).alias("d")), F.struct((F.col("c1") + 1).alias("x"), F.lit(-1).alias("d")))).alias("_e")).groupBy("image_id", "r", F.col("_e.x").alias("x")).agg(F.sum("_e.d").alias("d"))
    order = W.partitionBy("image_id", "r").orderBy("x")
    spans = events.select("image_id", "r", F.col("x").alias("c0"), (F.lead("x").over(order) - 1).alias("c1"), F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("n")).where(F.col("n") + outside >= 3)
    out = merge_runs(spans, ["image_id", "r"]).where((F.col("r") >= 0) & (F.col("r") < width))
    low = F.when(F.col("c0") <= 0, 0).otherwise(F.col("c0") + 1)
    high = F.when(F.col("c1") >= height - 1, height - 1).otherwise(F.col("c1") - 1)
    return out.select("image_id", F.lit(label).alias("label"), F.col("r").alias("x"), F.greatest(low, F.lit(0)).cast("int").alias("y0"), F.least(high, F.lit(height - 1)).cast("int").alias("y1")).where("y0 <= y1")


def band(width: int, frac: float) -> tuple[int, int]:
    half = max(10, int(width * frac / 2))
    return max(0, width // 2 - half), min(width, width // 2 + half)


def column_edges(label_runs: DataFrame, width: int, height: int, band_frac: float = 0.2, min_run_px: int = 15, min_valid_cols: int = 10) -> tuple[DataFrame, DataFrame]:
    """Best run of each middle column away from the border (image_id, x, y_top, y_bot); and per image the number of
    columns, border skips, and a reason if there are too few. label_runs: merged sidewalk runs."""
    low, high = band(width, band_frac)
    mid = label_runs.where((F.col("x") >= low) & (F.col("x") < high))
    # the median of a column's pixels, from its runs: half of the pixels lie below it
    col = W.partitionBy("image_id", "x")
    px = F.col("y1") - F.col("y0") + 1
    rows = mid.withColumns({"_n": F.sum(px).over(col), "_b": F.sum(px).over(col.orderBy("y0").rowsBetween(W.unboundedPreceding, 0)) - px})

    def at(k: Column) -> Column:
        return F.max(F.when((k >= F.col("_b")) & (k < F.col("_b") + px), F.col("y0") + k - F.col("_b")))

    k0, k1 = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    meds = rows.groupBy("image_id", "x").agg(((at(k0) + at(k1)) / 2.0).alias("m"))
    centers = meds.groupBy("image_id").agg(F.percentile("m", F.lit(0.5)).alias("y_center"))
    best = best_run_per_column(mid, centers, min_run_px)
    border = (F.col("y0") <= 1) | (F.col("y1") >= height - 2)
    stats = best.groupBy("image_id").agg(F.count_if(~border).alias("n_cols"), F.count_if(border).alias("border"))
    images = label_runs.select("image_id").distinct()
    status = images.join(centers, "image_id", "left").join(stats, "image_id", "left").select(
        "image_id", "y_center", F.coalesce("n_cols", F.lit(0)).alias("n_cols"), F.coalesce("border", F.lit(0)).alias("border"),
        F.when(F.col("y_center").isNull(), "M:no_sw_in_band").when(F.coalesce("n_cols", F.lit(0)) < min_valid_cols, "M:too_few_cols").alias("reason"),
    )
    return best.where(~border).select("image_id", "x", F.col("y0").cast("double").alias("y_top"), F.col("y1").cast("double").alias("y_bot")), status


def gradient_peak(gray: DataFrame, region: DataFrame) -> DataFrame:
    """Row of the strongest smoothed vertical gradient in each region, if above 3.
    gray: image_id, y, x, v; region: image_id, y0, y1 (exclusive), x0, x1 (exclusive)."""
    rows = gray.join(region, "image_id").where((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    diff = F.abs(F.lead("v").over(W.partitionBy("image_id", "x").orderBy("y")) - F.col("v"))
    profile = rows.withColumn("_g", diff).where("_g is not null").groupBy("image_id", "y").agg(F.avg("_g").alias("g"))
    w = W.partitionBy("image_id")
    n = F.count("*").over(w)
    k0 = F.least(F.lit(5), F.greatest(F.lit(3), F.floor(n / 5).cast("int")))
    rows = profile.withColumns({"_n": n, "_k": F.when(k0 % 2 == 1, k0).otherwise(k0 + 1)})
    o = w.orderBy("y")
    smooth = F.when(F.col("_n") < F.col("_k"), F.col("g")).when(F.col("_k") == 3, F.sum("g").over(o.rowsBetween(-1, 1)) / 3).otherwise(F.sum("g").over(o.rowsBetween(-2, 2)) / 5)
    best = rows.withColumn("_s", smooth).groupBy("image_id").agg(F.max("_s").alias("peak"), F.max_by("y", F.struct("_s", -F.col("y"))).alias("y_top"))
    return best.where("peak > 3.0").select("image_id", "y_top", "peak")


def overseg_check(edges: DataFrame, pose: DataFrame, height: int, cam_height: float, max_phys_width: float = 5.0, gray: DataFrame | None = None) -> DataFrame:
    """Per image: whether the median gap is above what a street's geometry allows, the refined top, and the reason."""
    per = edges.groupBy("image_id").agg(F.percentile("y_bot", F.lit(0.5)).alias("med_bot"), F.percentile(F.col("y_bot") - F.col("y_top"), F.lit(0.5)).alias("med_gap"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).join(pose.select("image_id", "fov"), "image_id")
    f = (height / 2.0) / (F.tan(F.col("fov") / 2.0) + 1e-9)
    dy = F.col("med_bot") - height / 2.0
    d = F.try_divide(f * cam_height, dy)
    per = per.withColumn("max_gap", F.when((F.col("fov") > 0.05) & (dy > 5), f * cam_height * max_phys_width / (d * (d + max_phys_width))))
    per = per.withColumn("over", F.coalesce(F.col("med_gap") > F.col("max_gap") * 1.3, F.lit(False)))
    if gray is not None:
        region = per.where("over").select("image_id", F.greatest(F.lit(0), F.floor(F.col("med_bot") - F.col("max_gap") * 1.5).cast("int")).alias("y0"), F.floor("med_bot").cast("int").alias("y1"), "x0", "x1")
        per = per.join(gradient_peak(gray, region).select("image_id", F.col("y_top").cast("double").alias("refined_top")), "image_id", "left")
    else:
        per = per.withColumn("refined_top", F.lit(None).cast("double"))
    return per.select("image_id", "med_bot", "med_gap", "max_gap", "over", "refined_top", F.when(F.col("over") & F.col("refined_top").isNull(), "M:over_seg").alias("reason"))


def bilinear_sample(cloud: DataFrame, coords: DataFrame, cloud_h: int, cloud_w: int) -> DataFrame:
    """x, y, z at fractional places (image_id, pt, xs, ys) from four neighbours with clamped indices."""
    x0 = F.greatest(F.lit(0), F.least(F.floor("xs"), F.lit(cloud_w - 2))).cast("int")
    y0 = F.greatest(F.lit(0), F.least(F.floor("ys"), F.lit(cloud_h - 2))).cast("int")
    rows = coords.withColumns({"_x": x0, "_y": y0}).withColumns({"_fx": F.col("xs") - F.col("_x"), "_fy": F.col("ys") - F.col("_y")})
    corners = F.array(*[F.struct((F.col("_y") + dy).alias("yd"), (F.col("_x") + dx).alias("xd"), ((F.col("_fx") if dx else 1 - F.col("_fx")) * (F.col("_fy") if dy else 1 - F.col("_fy"))).alias("w")) for dy in (0, 1) for dx in (0, 1)])
    rows = rows.select("image_id", "pt", F.explode(corners).alias("_c")).select("image_id", "pt", "_c.yd", "_c.xd", "_c.w")
    # merged at every size: a cloud made by explode looks small to the planner, which would collect it in the driver to broadcast it
    return rows.join(cloud.hint("merge"), ["image_id", "yd", "xd"]).groupBy("image_id", "pt").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in "xyz"], F.count("*").alias("_n")).where("_n = 4").drop("_n")


def gather_ground(cloud: DataFrame, label_runs: DataFrame, size: tuple[int, int], cloud_size: tuple[int, int], max_samples: int = 40_000, least: int = 50) -> DataFrame:
    """Points whose nearest image pixel is sidewalk or road; of each image the ``max_samples`` with the smallest hash
    (a feature of the fit), images with fewer than ``least`` are absent. size: (height, width)."""
    (h, w), (hd, wd) = size, cloud_size
    px = F.least(F.lit(w - 1), F.floor(F.col("xd") * (w / wd)).cast("int"))
    py = F.least(F.lit(h - 1), F.floor(F.col("yd") * (h / hd)).cast("int"))
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in "xyz"]
    points = cloud.where(finite[0] & finite[1] & finite[2]).withColumns({"_px": px, "_py": py})
    runs = label_runs.where(F.col("label").isin("sidewalk", "road")).select(F.col("image_id").alias("_i"), F.col("x").alias("_x"), "y0", "y1")
    rows = points.join(runs.hint("merge"), (F.col("image_id") == F.col("_i")) & (F.col("_px") == F.col("_x")) & F.col("_py").between(F.col("y0"), F.col("y1")), "left_semi")
    o = W.partitionBy("image_id").orderBy(F.md5(F.concat_ws(",", "image_id", "yd", "xd")))
    rows = rows.withColumns({"pt": F.row_number().over(o) - 1, "_n": F.count("*").over(W.partitionBy("image_id"))})
    return rows.where((F.col("pt") < max_samples) & (F.col("_n") >= least)).select("image_id", "pt", "x", "y", "z")


def wanted_cells(label_runs: DataFrame, coords: DataFrame, size: tuple[int, int], cloud_size: tuple[int, int]) -> DataFrame:
    """image_id, yd, xd of the points that :func:`gather_ground` and :func:`bilinear_sample` may read, so that a cloud is dealt once for both."""
    (h, w), (hd, wd) = size, cloud_size
    spark = label_runs.sparkSession
    column = spark.range(wd).select(F.col("id").cast("int").alias("xd"), F.least(F.lit(w - 1), F.floor(F.col("id") * (w / wd)).cast("int")).alias("x"))
    row = spark.range(hd).select(F.col("id").cast("int").alias("yd"), F.least(F.lit(h - 1), F.floor(F.col("id") * (h / hd)).cast("int")).alias("_py"))
    runs = label_runs.where(F.col("label").isin("sidewalk", "road")).select("image_id", "x", "y0", "y1")
    ground = runs.join(F.broadcast(column), "x").join(F.broadcast(row), F.col("_py").between(F.col("y0"), F.col("y1"))).select("image_id", "yd", "xd")
    x0 = F.greatest(F.lit(0), F.least(F.floor("xs"), F.lit(wd - 2))).cast("int")
    y0 = F.greatest(F.lit(0), F.least(F.floor("ys"), F.lit(hd - 2))).cast("int")
    corners = F.explode(F.array(*[F.struct((F.col("_y") + dy).alias("yd"), (F.col("_x") + dx).alias("xd")) for dy in (0, 1) for dx in (0, 1)]))
    edges = coords.select("image_id", y0.alias("_y"), x0.alias("_x")).distinct().select("image_id", corners.alias("_c")).select("image_id", "_c.*")
    return ground.unionByName(edges).distinct()


# ---------------------------------------------------------------- planes


def covariance(points: DataFrame, keys: list[str]) -> DataFrame:
    m = points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])
    return m


def _eigen(largest: bool) -> tuple[Column, list[Column]]:
    """Eigenvalue (by the trigonometric formula) and an eigenvector of the symmetric matrix cxx..czz."""
    a, b, c, d, e, f = (F.col(n) for n in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz"))
    q = (a + d + f) / 3
    p = F.sqrt(((a - q) ** 2 + (d - q) ** 2 + (f - q) ** 2 + 2 * (b * b + c * c + e * e)) / 6)
    det = (a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(1.0))))
    phi = F.acos(r) / 3
    return q + 2 * p * F.cos(phi + (0 if largest else 2 * math.pi / 3)), [a, b, c, d, e, f]


def with_eigenvector(cov: DataFrame, largest: bool, names: tuple[str, str, str]) -> DataFrame:
    """Adds a unit eigenvector: the longest cross product of two rows of (matrix - eigenvalue)."""
    value, (a, b, c, d, e, f) = _eigen(largest)
    rows = cov.withColumn("_l", value)
    lam = F.col("_l")
    r0, r1, r2 = (a - lam, b, c), (b, d - lam, e), (c, e, f - lam)

    def cross(u, v):
        return (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])

    options = []
    for u, v in ((r0, r1), (r0, r2), (r1, r2)):
        x, y, z = cross(u, v)
        options.append(F.struct((x * x + y * y + z * z).alias("s"), x.alias("x"), y.alias("y"), z.alias("z")))
    rows = rows.withColumn("_v", F.greatest(*options))
    n = F.sqrt("_v.s")
    return rows.withColumns({k: F.try_divide(F.col(f"_v.{c}"), n) for k, c in zip(names, "xyz", strict=True)}).drop("_v", "_l")


def fit_plane(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares plane nx, ny, nz, d and the number of points."""
    p = with_eigenvector(covariance(points, keys), False, ("nx", "ny", "nz"))
    return p.where("nx is not null").select(*keys, "nx", "ny", "nz", (-(F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz"))).alias("d"), "n")


def distance_to() -> Column:
    return F.abs(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("d"))


BLOCKS, STRIP = 8, 64


def plane_inlier_join(points: DataFrame, hypotheses: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Inliers of each hypothesis (image_id, hyp, nx, ny, nz, d) among its image's points.

    An image's hypotheses travel as one row of arrays and its points in ``BLOCKS`` blocks by hash; each (image, block) is
    counted as matrices, so that rows are hypotheses times blocks and never times points. A bounded number of hypotheses an image is assumed."""
    image = points.schema["image_id"].dataType.simpleString()
    hyp = hypotheses.schema["hyp"].dataType.simpleString()
    arrays = F.array_sort(F.collect_list(F.struct("hyp", "nx", "ny", "nz", "d")))
    packed = hypotheses.groupBy("image_id").agg(arrays.alias("h")).join(thresholds.select("image_id", "thresh"), "image_id")
    packed = packed.select(F.col("image_id").alias("image_id"), "thresh", *[F.col(f"h.{c}").alias(c) for c in ("hyp", "nx", "ny", "nz", "d")], F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("_b"))
    dealt = points.select("image_id", *[F.col(c).cast("double").alias(c) for c in "xyz"], F.pmod(F.xxhash64("x", "y", "z"), F.lit(BLOCKS)).cast("int").alias("_b"))

    def count(mine: pa.Table, planes: pa.Table) -> pa.Table:
        out = {"image_id": [], "hyp": [], "n": []}
        x, y, z = (mine[c].to_numpy() for c in "xyz")
        for row in planes.to_pylist() if len(x) else []:
            nx, ny, nz, d = (np.array(row[c], float)[:, None] for c in ("nx", "ny", "nz", "d"))
            for at in range(0, len(nx), STRIP):
                part = slice(at, at + STRIP)
                near = np.abs(nx[part] * x + ny[part] * y + nz[part] * z + d[part]) < row["thresh"]
                out["n"] += near.sum(axis=1).tolist()
            out["hyp"] += row["hyp"]
            out["image_id"] += [row["image_id"]] * len(row["hyp"])
        return pa.table({"image_id": pa.array(out["image_id"], mine.schema.field("image_id").type), "hyp": pa.array(out["hyp"], planes.schema.field("hyp").type.value_type), "n": pa.array(out["n"], pa.int64())})

    counts = dealt.groupBy("image_id", "_b").cogroup(packed.groupBy("image_id", "_b")).applyInArrow(count, f"image_id {image}, hyp {hyp}, n long")
    return counts.groupBy("image_id", "hyp").agg(F.sum("n").alias("inliers"))


def plane_hypotheses(points: DataFrame, iters: int) -> DataFrame:
    """Planes through ``iters`` triples of each image's points, picked by hash without replacement; triples whose normal is shorter than
    1e-8 give none. points have pt from 0, three of them at least."""
    n = points.groupBy("image_id").agg(F.count("*").alias("n")).where("n >= 3")
    draws = n.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(iters - 1))).alias("hyp"), "n")
    a, b, c = (F.pmod(F.xxhash64("image_id", "hyp", F.lit(k)), F.col("n") - k) for k in range(3))
    draws = draws.withColumns({"_a": a, "_b": b, "_c": c})
    # the second skips the first, the third skips both in order
    draws = draws.withColumn("_b", F.col("_b") + (F.col("_b") >= F.col("_a")).cast("int"))
    low, high = F.least("_a", "_b"), F.greatest("_a", "_b")
    draws = draws.withColumn("_c", F.col("_c") + (F.col("_c") >= low).cast("int")).withColumn("_c", F.col("_c") + (F.col("_c") >= high).cast("int"))
    picks = draws.select("image_id", "hyp", F.posexplode(F.array("_a", "_b", "_c")).alias("k", "pt"))
    rows = picks.hint("merge").join(points, ["image_id", "pt"]).groupBy("image_id", "hyp").agg(*[F.max(F.when(F.col("k") == k, F.struct("x", "y", "z"))).alias(f"p{k}") for k in range(3)])
    u = [F.col(f"p1.{c}") - F.col(f"p0.{c}") for c in "xyz"]
    v = [F.col(f"p2.{c}") - F.col(f"p0.{c}") for c in "xyz"]
    w = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    rows = rows.select("image_id", "hyp", "p0", *[x.alias(f"w{c}") for x, c in zip(w, "xyz", strict=True)]).withColumn("_n", F.sqrt(F.col("wx") ** 2 + F.col("wy") ** 2 + F.col("wz") ** 2)).where("_n >= 1e-8")
    rows = rows.select("image_id", "hyp", "p0", *[(F.col(f"w{c}") / F.col("_n")).alias(f"n{c}") for c in "xyz"])
    return rows.select("image_id", "hyp", "nx", "ny", "nz", (-(F.col("nx") * F.col("p0.x") + F.col("ny") * F.col("p0.y") + F.col("nz") * F.col("p0.z"))).alias("d"))


#: Images of at most so many points are fitted in one row of a task.
WHOLE = 40_000


def best_hypotheses(points: DataFrame, thresholds: DataFrame, iters: int) -> DataFrame:
    """image_id, nx, ny, nz, d and inliers of the hypothesis with the most inliers (the first of equals), as :func:`plane_hypotheses` and
    :func:`plane_inlier_join` find it, for images whose points fit a row: the points travel once and the hypotheses never, for
    they are many times as large."""
    image = points.schema["image_id"].dataType.simpleString()
    packed = points.groupBy("image_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pt", *[F.col(c).cast("double").alias(c) for c in "xyz"]))).alias("p")).where("n >= 3")

    def drawn(k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(iters - 1)), lambda h: F.pmod(F.xxhash64("image_id", h, F.lit(k)), F.col("n") - k).cast("int")).alias("abc"[k])

    rows = packed.join(thresholds.select("image_id", "thresh"), "image_id").select("image_id", "thresh", F.col("p.pt").alias("pt"), *[F.col(f"p.{c}").alias(c) for c in "xyz"], *map(drawn, range(3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_plane(*(batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("pt", "x", "y", "z", "a", "b", "c")), batch["thresh"][i].as_py()) for i in range(batch.num_rows)]
            there = [i for i, f in enumerate(found) if f]
            columns = list(zip(*(found[i] for i in there), strict=True)) or [[]] * 5
            kinds = [pa.float64()] * 4 + [pa.int64()]
            yield pa.record_batch([batch["image_id"].take(pa.array(there, pa.int64())), *[pa.array(v, k) for v, k in zip(columns, kinds, strict=True)]], ["image_id", "nx", "ny", "nz", "d", "inliers"])

    return rows.mapInArrow(run, f"image_id {image}, nx double, ny double, nz double, d double, inliers long")


def best_plane(pt: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, thresh: float) -> tuple | None:
    """nx, ny, nz, d and inliers of the best plane through the points numbered a, b, c (without replacement). pt is sorted."""
    b = b + (b >= a)
    low, high = np.minimum(a, b), np.maximum(a, b)
    c = c + (c >= low)
    c = c + (c >= high)
    place = np.full(len(pt), -1)
    inside = pt < len(pt)
    place[pt[inside]] = np.flatnonzero(inside)
    picks = np.stack([place[a], place[b], place[c]])
    picks = picks[:, (picks >= 0).all(axis=0)]
    p = np.stack([x, y, z])
    p0 = p[:, picks[0]]
    (ux, uy, uz), (vx, vy, vz) = p[:, picks[1]] - p0, p[:, picks[2]] - p0
    w = np.stack([uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx])
    size = np.sqrt(w[0] ** 2 + w[1] ** 2 + w[2] ** 2)
    real = size >= 1e-8
    if not real.any():
        return None
    n, p0 = w[:, real] / size[real], p0[:, real]
    d = -(n[0] * p0[0] + n[1] * p0[1] + n[2] * p0[2])
    near = np.zeros(len(d), np.int64)
    for at in range(0, len(d), STRIP):
        nx, ny, nz, off = (v[at : at + STRIP, None] for v in (*n, d))
        near[at : at + STRIP] = (np.abs(nx * x + ny * y + nz * z + off) < thresh).sum(axis=1)
    best = int(near.argmax())
    return (*n[:, best].tolist(), float(d[best]), int(near[best]))


def fit_ground_plane(points: DataFrame, iters: int = 1000, min_inlier_ratio: float = 0.3, least: int = 50) -> DataFrame:
    """image_id, nx, ny, nz, d, inliers and refined: a coarse plane sets the threshold, the best of the hypotheses is
    refined on its inliers; with too few of them the coarse plane stays. points: image_id, pt, x, y, z.

    Images of more than ``WHOLE`` points are counted in blocks, others in a row each; both try all hypotheses on all points."""
    coarse = settle(fit_plane(points, ["image_id"]).where(F.col("n") >= least), "coarse")
    near = points.join(coarse, "image_id").withColumn("_r", distance_to())
    w = W.partitionBy("image_id")
    near = near.withColumn("_m", F.percentile("_r", F.lit(0.5)).over(w)).withColumn("_a", F.abs(F.col("_r") - F.col("_m")))
    thresholds = near.groupBy("image_id").agg((2.5 * 1.4826 * F.percentile("_a", F.lit(0.5))).alias("t")).select("image_id", F.greatest(F.lit(0.005), F.least(F.lit(0.05), F.col("t"))).alias("thresh"))
    ok = points.join(coarse.select("image_id"), "image_id", "left_semi")
    thresholds = settle(thresholds, "thresholds")
    best = best_hypotheses(points.join(coarse.where(F.col("n") <= WHOLE).select("image_id"), "image_id", "left_semi"), thresholds, iters)
    if coarse.where(F.col("n") > WHOLE).limit(1).count():
        large = points.join(coarse.where(F.col("n") > WHOLE).select("image_id"), "image_id", "left_semi")
        hyps = settle(plane_hypotheses(large, iters), "hypotheses")
        counts = plane_inlier_join(large, hyps, thresholds)
        first = counts.groupBy("image_id").agg(F.max(F.struct(F.col("inliers"), (-F.col("hyp")).alias("h"))).alias("b")).select("image_id", F.col("b.inliers").alias("inliers"), (-F.col("b.h")).alias("hyp"))
        best = best.unionByName(first.join(hyps, ["image_id", "hyp"]).drop("hyp"))
    top = settle(best.join(thresholds, "image_id").join(coarse.select("image_id", F.col("n").alias("n_points")), "image_id").where(F.col("inliers") >= F.greatest(F.floor(min_inlier_ratio * F.col("n_points")), F.lit(30))), "best")
    inliers = ok.join(top.select("image_id", "nx", "ny", "nz", "d", "thresh"), "image_id").where(distance_to() < F.col("thresh")).select("image_id", "x", "y", "z")
    fine = fit_plane(inliers, ["image_id"]).select("image_id", *[F.col(c).alias(f"f_{c}") for c in ("nx", "ny", "nz", "d", "n")])
    out = coarse.join(fine, "image_id", "left")
    return out.select("image_id", *[F.coalesce(f"f_{c}", c).alias(c) for c in ("nx", "ny", "nz", "d")], F.col("f_n").alias("inliers"), F.col("f_n").isNotNull().alias("refined"))


def project_to_plane(points: DataFrame, planes: DataFrame) -> DataFrame:
    """Points moved along the normal onto the image's plane."""
    rows = points.join(planes.select("image_id", "nx", "ny", "nz", "d"), "image_id")
    s = F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("d")
    return rows.withColumn("_s", s).select(*[c for c in points.columns if c not in "xyz"], *[(F.col(c) - F.col("_s") * F.col(f"n{c}")).alias(c) for c in "xyz"])


def metric_scale(planes: DataFrame, pose: DataFrame, cam_height: float) -> DataFrame:
    """Camera height over the camera's distance to the plane, and the reason why it can't be used."""
    rows = planes.join(pose, "image_id")
    h = F.abs(F.col("nx") * F.col("cx") + F.col("ny") * F.col("cy") + F.col("nz") * F.col("cz") + F.col("d"))
    rows = rows.withColumn("_h", h).withColumn("scale", F.when(F.col("_h") >= 1e-6, cam_height / F.col("_h")))
    reason = F.when(F.col("_h") < 1e-6, "M:cam_on_plane").when((F.col("scale") < 0.2) | (F.col("scale") > 50), "M:bad_scale")
    return rows.select("image_id", "scale", reason.alias("reason"))


def across_width(edge_points: DataFrame, planes: DataFrame) -> DataFrame:
    """Width of each column (image_id, x, width) from projected metric edge points (image_id, col, side, x, y, z):
    the part across the main direction, or the plain distance where the two disagree; 0.05 to 15 m, three or more."""
    cov = with_eigenvector(covariance(edge_points, ["image_id"]), True, ("ax", "ay", "az"))
    rows = cov.join(planes.select("image_id", "nx", "ny", "nz"), "image_id")
    a, n = [F.col(f"a{c}") for c in "xyz"], [F.col(f"n{c}") for c in "xyz"]
    cross = (n[1] * a[2] - n[2] * a[1], n[2] * a[0] - n[0] * a[2], n[0] * a[1] - n[1] * a[0])
    rows = rows.select("image_id", *[x.alias(f"w{c}") for x, c in zip(cross, "xyz", strict=True)]).withColumn("_n", F.sqrt(F.col("wx") ** 2 + F.col("wy") ** 2 + F.col("wz") ** 2) + 1e-12)
    pairs = edge_points.groupBy("image_id", "col").agg(*[(F.max(F.when(F.col("side") == "top", F.col(c))) - F.max(F.when(F.col("side") == "bot", F.col(c)))).alias(f"d{c}") for c in "xyz"])
    both = pairs.join(rows, "image_id").withColumns({"w_across": F.abs(F.col("dx") * F.col("wx") + F.col("dy") * F.col("wy") + F.col("dz") * F.col("wz")) / F.col("_n"), "w_raw": F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)})
    w = W.partitionBy("image_id")
    ratio = F.percentile("w_across", F.lit(0.5)).over(w) / (F.percentile("w_raw", F.lit(0.5)).over(w) + 1e-9)
    both = both.withColumn("_ratio", ratio).withColumn("width", F.when((F.col("_ratio") > 0.5) & (F.col("_ratio") < 1.05), F.col("w_across")).otherwise(F.col("w_raw")))
    ok = both.where((F.col("width") > 0.05) & (F.col("width") < 15)).withColumn("_n2", F.count("*").over(w))
    return ok.where("_n2 >= 3").select("image_id", F.col("col").alias("x"), "width")


def measure_width_points(label_runs: DataFrame, cloud: DataFrame, pose: DataFrame, size: tuple[int, int], cloud_size: tuple[int, int], cam_height: float = 1.8, gray: DataFrame | None = None, band_frac: float = 0.2, min_run_px: int = 15, min_valid_cols: int = 10, width_range: tuple[float, float] = (0.5, 4.0), max_phys_width: float = 5.0, max_cv: float = 0.4, iters: int = 1000) -> DataFrame:
    """image_id, width_m, n_cols, reason (the first that failed, '' if none) and figures of every posed image."""
    (h, w), (hd, wd) = size, cloud_size
    # each step is written once, as several later ones read it
    clean = settle(clean_label_mask(label_runs, w, h), "clean")
    edges, status = column_edges(clean, w, h, band_frac, min_run_px, min_valid_cols)
    edges, status = settle(edges, "edges"), settle(status, "status")
    enough = status.where("reason is null").select("image_id")
    over = settle(overseg_check(edges.join(enough, "image_id", "left_semi"), pose, h, cam_height, max_phys_width, gray), "overseg")
    rows = edges.join(over.where("reason is null").select("image_id", "refined_top"), "image_id").withColumn("y_top", F.coalesce("refined_top", "y_top")).drop("refined_top")
    for c in ("y_top", "y_bot"):
        rows = mad_filter(rows, ["image_id"], c, 3.0).withColumnRenamed("inlier", f"_{c}")
    rows = rows.where("_y_top and _y_bot").withColumn("_n", F.count("*").over(W.partitionBy("image_id")))
    steady = settle(rows.where(F.col("_n") >= min_valid_cols), "steady")
    sx, sy = (wd - 1) / max(w - 1, 1), (hd - 1) / max(h - 1, 1)
    coords = steady.select("image_id", F.explode(F.array(*[F.struct((F.col("x") * 2 + k).alias("pt"), (F.col("x") * sx).alias("xs"), (F.col(c) * sy).alias("ys")) for k, c in ((0, "y_top"), (1, "y_bot"))])).alias("_c")).select("image_id", "_c.*")
    cells = wanted_cells(label_runs, coords, size, cloud_size)
    cloud = settle(cloud.join(cells.hint("merge"), ["image_id", "yd", "xd"], "left_semi"), "cloud")
    points = bilinear_sample(cloud, coords, hd, wd).where(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) < 1e5)
    points = points.withColumns({"col": F.floor(F.col("pt") / 2).cast("int"), "side": F.when(F.col("pt") % 2 == 0, "top").otherwise("bot")}).withColumn("_both", F.count("*").over(W.partitionBy("image_id", "col"))).where("_both = 2")
    points = points.withColumn("_cols", F.count("*").over(W.partitionBy("image_id")) / 2).where(F.col("_cols") >= min_valid_cols).drop("pt", "_both", "_cols")
    points = settle(points, "edge-points")
    ground = settle(gather_ground(cloud, label_runs, size, cloud_size), "ground")
    planes = settle(fit_ground_plane(ground, iters), "planes")
    scale = settle(metric_scale(planes, pose, cam_height), "scale")
    good = scale.where("reason is null")
    flat = project_to_plane(points, planes).join(good.select("image_id", "scale"), "image_id").select("image_id", "col", "side", *[(F.col(c) * F.col("scale")).alias(c) for c in "xyz"])
    widths = mad_filter(across_width(flat, planes), ["image_id"], "width", 2.5).where("inlier")
    final = widths.groupBy("image_id").agg(F.percentile("width", F.lit(0.5)).alias("width_m"), F.stddev_pop("width").alias("width_std"), F.count("*").alias("n_cols"))
    meds = steady.groupBy("image_id").agg(F.percentile("y_top", F.lit(0.5)).alias("y_top_med"), F.percentile("y_bot", F.lit(0.5)).alias("y_bot_med"))

    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("image_id").distinct().withColumn(name, F.lit(True))

    out = pose.select("image_id", "fov").join(status.select("image_id", F.col("reason").alias("r1")), "image_id", "left").join(over.select("image_id", F.col("reason").alias("r2")), "image_id", "left")
    for df, name in ((steady, "f_steady"), (points, "f_points"), (ground, "f_ground"), (planes, "f_plane")):
        out = out.join(flag(df, name), "image_id", "left")
    out = out.join(scale.select("image_id", "scale", F.col("reason").alias("r3")), "image_id", "left").join(final, "image_id", "left").join(meds, "image_id", "left")
    f = (h / 2.0) / (F.tan(F.col("fov") / 2.0) + 1e-9)
    dy_t, dy_b = F.col("y_top_med") - h / 2.0, F.col("y_bot_med") - h / 2.0
    geom = F.when((F.col("fov") > 0.05) & (dy_t > 5) & (dy_b > dy_t), F.abs(F.try_divide(f * cam_height, dy_t) - F.try_divide(f * cam_height, dy_b)))
    ratio = F.when(geom > 0.01, F.col("width_m") / geom)
    reason = (
        F.when(F.col("r1").isNotNull(), F.col("r1")).when(F.col("r2").isNotNull(), F.col("r2")).when(F.col("f_steady").isNull(), "M:inconsistent_edges")
        .when(F.col("f_points").isNull(), "M:invalid_3d_pts").when(F.col("f_ground").isNull(), "M:no_ground_pts").when(F.col("f_plane").isNull(), "M:plane_fit_fail").when(F.col("r3").isNotNull(), F.col("r3"))
        .when(F.col("width_m").isNull(), "M:unreasonable_widths").when(F.col("n_cols") < 3, "M:too_few_inliers").when(~F.col("width_m").between(*width_range), "M:out_of_range")
        .when(F.col("width_std") / (F.col("width_m") + 1e-9) > max_cv, "M:width_inconsistent").when((ratio > 3.0) | (ratio < 0.33), "M:geom_mismatch").otherwise("")
    )
    out = out.withColumn("reason", reason)
    ok = F.col("reason") == ""
    return out.select("image_id", F.when(ok, F.col("width_m")).alias("width_m"), F.when(ok, F.col("n_cols")).otherwise(0).alias("n_cols"), "reason", "scale", "width_std", "y_top_med", "y_bot_med")


def alt_width_batch(images: DataFrame, measured: DataFrame, pose: DataFrame | None = None, failures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A status document for every image, and one row of counts with a map of reasons.

    What kept an image from being measured, the first that holds: E:no_pose_enc where ``pose`` (image_id) lacks it, the reason in
    ``failures`` (image_id, reason: such as E:imread_fail for a file that could not be decoded, or E:exception with the message; the least of several), and
    E:missing without a measurement. A failed image has no width. Counts leave messages in brackets out."""
    docs = images.join(measured, "image_id", "left").withColumn("_failed", F.lit(None).cast("string"))
    if failures is not None:
        docs = docs.drop("_failed").join(failures.groupBy("image_id").agg(F.min("reason").alias("_failed")), "image_id", "left")
    if pose is not None:
        docs = docs.join(pose.select("image_id").distinct().withColumn("_posed", F.lit(True)), "image_id", "left").withColumn("_failed", F.when(F.col("_posed").isNull(), "E:no_pose_enc").otherwise(F.col("_failed"))).drop("_posed")
    error = F.coalesce("_failed", F.when(F.col("reason").isNull(), "E:missing"))
    docs = docs.withColumn("_error", error).withColumn("reason", F.coalesce("_error", "reason")).withColumn("status", F.when(F.col("reason") == "", "ok").otherwise("failed"))
    docs = docs.withColumns({c: F.when(F.col("_error").isNull(), F.col(c)) for c in ("width_m", "n_cols") if c in docs.columns}).drop("_error", "_failed")
    counts = docs.groupBy(F.regexp_replace("reason", r"\(.*\)$", "").alias("reason")).agg(F.count("*").alias("n"))
    summary = counts.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("reason") == "", F.col("n"))), F.lit(0)).alias("ok"), F.coalesce(F.sum(F.when(F.col("reason") != "", F.col("n"))), F.lit(0)).alias("failed"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason") != "", F.struct("reason", "n"))))).alias("reasons"))
    return docs, summary
