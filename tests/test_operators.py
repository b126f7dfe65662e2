"""Operators against independent statements in plain Python and numpy."""

from __future__ import annotations

import json
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curbline.functions import geo, names
from curbline.operators import cloud, detect, evaluate, filters, graph, nearest, raster, resolve, runs, sampling
from curbline.plans import registry
from curbline.sources import readers, writers
from curbline.streaming.reports import stream_reports


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def png(grid: np.ndarray) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = grid.shape
    raw = b"".join(b"\0" + r.tobytes() for r in grid.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


# ---------------------------------------------------------------- names and geometry


def test_parse_image_name(spark):
    p = one(spark, names.parse_image_name(F.lit("a/012-0007_forward_40.97_29.06_125.2.jpg")))
    assert (p.segment_id, p.point_id, p.direction, p.lat, p.lon, p.heading, p.coordinate_folder) == ("012", "0007", "forward", "40.97", "29.06", "125.2", "0007_40.97_29.06")
    q = one(spark, names.parse_image_name(F.lit("0574_left_40.9_-29.0_1.0.png")))
    assert q.segment_id == "0" and q.lon == "-29.0"
    assert one(spark, names.parse_image_name(F.lit("012-0007_left_1_2_3.jpg"), "two_way")) is None
    assert one(spark, names.parse_image_name(F.lit("012-0007_left_1_2_3.jpg"), "plain")) is None
    assert one(spark, names.parse_image_name(F.lit("x_up_1_2_3.jpg"))) is None
    assert one(spark, names.numeric_prefix(F.lit("012-0007_left_1_2_3.jpg"))) == 12
    assert one(spark, names.numeric_prefix(F.lit("012-0007_left_1_2_3.jpg"), "point")) == 7


def test_small_names(spark):
    assert one(spark, names.slug(F.lit(" Kadıköy Moda, Istanbul"))) == "kadıköy_moda"
    assert one(spark, names.safe_prompt(F.lit("side walk / çit!"))) == "side_walk_çit"
    assert one(spark, names.strip_uri(F.lit("gs://b/a/c.jpg"))) == "a/c.jpg" and one(spark, names.strip_uri(F.lit("a/c.jpg"))) == "a/c.jpg"
    with pytest.raises(Exception, match="not in the bucket"):
        one(spark, names.strip_uri(F.lit("gs://x/a"), "b"))
    assert one(spark, names.capture_key(F.lit(3), F.lit(7), F.lit("left"), F.lit("1.5"), F.lit("2.5"), F.lit(90.0))) == "003-0007_left_1.5_2.5_90.0.jpg"
    assert one(spark, names.mask_key(F.lit("r/7_1_2/forward/sidewalk/mask_001.png"))) == "sidewalk_forward_001"
    assert one(spark, names.mask_key(F.lit("a/mask_001.png"))) is None
    assert one(spark, names.parse_folder(F.lit("7_40.5_29.5"))) == (40.5, 29.5) and one(spark, names.parse_folder(F.lit("7_x_unknown"))) is None


def test_geodesy(spark):
    lit = F.lit
    assert one(spark, geo.bearing(lit(0.0), lit(0.0), lit(0.0), lit(1.0))) == pytest.approx(90)
    assert one(spark, geo.bearing(lit(0.0), lit(0.0), lit(-1.0), lit(0.0))) == pytest.approx(180)
    assert one(spark, geo.haversine_m(lit(0.0), lit(0.0), lit(0.0), lit(180.0))) == pytest.approx(np.pi * 6371000)
    p = one(spark, geo.project_metric(lit(29.06), lit(40.97), lit(35)))
    g = one(spark, geo.unproject_wgs84(lit(p.x), lit(p.y), lit(35)))
    assert (g.lon, g.lat) == (pytest.approx(29.06, abs=1e-9), pytest.approx(40.97, abs=1e-9))
    # the central meridian keeps its easting, and its northing is the scaled meridian arc
    c = one(spark, geo.project_metric(lit(27.0), lit(45.0), lit(35)))
    assert c.x == pytest.approx(500000) and c.y == pytest.approx(0.9996 * 4984944.378, abs=0.01)
    assert one(spark, geo.pinhole_width_cm(lit(100.0), lit(300.0), lit(340), 480, 2.0)) == pytest.approx(400)
    assert one(spark, geo.pinhole_width_cm(lit(1.0), lit(3.0), lit(240), 480, 2.0)) is None
    assert one(spark, geo.round_compat(lit(12.25), 1)) == 12.2
    with pytest.raises(ValueError, match="three vertices"):
        geo.in_polygon(lit(0), lit(0), [(0, 0), (1, 1)])


# ---------------------------------------------------------------- runs


def grid_runs(spark, grids: dict, keys=("image_id", "mask_key", "class_name")):
    rows = []
    for key, g in grids.items():
        r, a, b = readers.line_runs(g)
        rows += [(*key, int(x), int(y), int(z)) for x, y, z in zip(r, a, b, strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{k} {'int' if k == 'image_id' else 'string'}" for k in keys) + ", r int, c0 int, c1 int")


def paint(rows, shape) -> np.ndarray:
    out = np.zeros(shape, bool)
    for r, a, b in rows:
        out[r, a : b + 1] = True
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=9, max_size=9), min_size=1, max_size=6))
def test_runs_and_pixels_round_trip(grid):
    g = np.array(grid)
    assert (paint(zip(*readers.line_runs(g), strict=True), g.shape) == g).all()


def test_run_algebra(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random((30, 40)) < 0.6, rng.random((30, 40)) < 0.4
    ra, rb = grid_runs(spark, {(1, "a", "x"): a}), grid_runs(spark, {(1, "b", "x"): b})
    both = ra.unionByName(rb).select("image_id", "r", "c0", "c1")
    assert (paint(runs.merge_runs(both, ["image_id", "r"]).select("r", "c0", "c1").collect(), a.shape) == (a | b)).all()
    left = runs.subtract_runs(ra, rb, ["image_id", "r"])
    assert (paint(left.select("r", "c0", "c1").collect(), a.shape) == (a & ~b)).all()
    layers = ra.withColumns({"layer": F.lit("a"), "draw_order": F.lit(1)}).unionByName(rb.withColumns({"layer": F.lit("b"), "draw_order": F.lit(2)})).drop("mask_key", "class_name")
    top = runs.silhouette_layers(layers)
    assert (paint(top.where("layer = 'b'").select("r", "c0", "c1").collect(), a.shape) == b).all()
    assert (paint(top.where("layer = 'a'").select("r", "c0", "c1").collect(), a.shape) == (a & ~b)).all()


def flood(g: np.ndarray) -> list[set]:
    seen, out = np.zeros(g.shape, bool), []
    for start in zip(*np.nonzero(g), strict=True):
        if seen[start]:
            continue
        stack, comp = [start], set()
        seen[start] = True
        while stack:
            r, c = stack.pop()
            comp.add((int(r), int(c)))
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    n = (r + dr, c + dc)
                    if 0 <= n[0] < g.shape[0] and 0 <= n[1] < g.shape[1] and g[n] and not seen[n]:
                        seen[n] = True
                        stack.append(n)
        out.append(comp)
    return out


def test_components(spark):
    rng = np.random.default_rng(7)
    grids = {(i, "m", "x"): rng.random((25, 150)) < p for i, p in enumerate((0.2, 0.35, 0.5))}
    comp = graph.mask_components(grid_runs(spark, grids), ["image_id", "mask_key"])
    boxes = graph.component_bbox(comp, ["image_id", "mask_key"]).collect()
    for (i, _, _), g in grids.items():
        want = sorted((len(c), min(p[0] for p in c), max(p[1] for p in c) + 1) for c in flood(g))
        assert want == sorted((b.area, b.min_row, b.max_col) for b in boxes if b.image_id == i)


def test_graph_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.id: r.comp_id for r in graph.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: root(x) for x in up}


# ---------------------------------------------------------------- streets


def walk_chains(edges):
    """Chains as lists of edge ids, by walking."""
    near = {}
    for e, u, v in edges:
        near.setdefault(u, []).append((e, v))
        near.setdefault(v, []).append((e, u))
    used, out = set(), []

    def go(start, e, v):
        chain = [e]
        used.add(e)
        while len(near[v]) == 2 and v != start:
            nxt = [(f, w) for f, w in near[v] if f not in used]
            if not nxt:
                break
            e, v = nxt[0]
            used.add(e)
            chain.append(e)
        return chain

    for n in sorted(near):
        if len(near[n]) != 2:
            out += [go(n, e, v) for e, v in near[n] if e not in used]
    for n in sorted(near):
        out += [go(n, e, v) for e, v in near[n] if e not in used]
    return out


def test_chain_decompose(spark):
    rng = random.Random(9)
    edges = [(i, i, i + 1) for i in range(1, 40)] + [(100 + i, 5 * i, 200 + i) for i in range(1, 5)] + [(300 + i, 300 + i, 300 + (i + 1) % 7) for i in range(7)] + [(400, 20, 35), (500, 60, 61)]
    edges += [(600 + i, 700 + i, 701 + i) for i in range(64)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(e, u, v, 10.0 + e, f"s{e}") for e, u, v in edges], "edge_id int, u int, v int, length double, name string")
    got = graph.chain_decompose(df).toPandas().sort_values(["chain_id", "pos"])
    assert sorted(got["edge_id"]) == sorted(e for e, _, _ in edges)
    chains = [list(c["edge_id"]) for _, c in got.groupby("chain_id")]
    key = lambda c: min(tuple(c), tuple(reversed(c)))
    want = walk_chains(edges)
    assert {frozenset(c) for c in chains} == {frozenset(c) for c in want}
    closed = got[got["closed"]]
    assert set(closed["edge_id"]) == set(range(300, 307)) and closed["u"].iloc[0] == 300
    for _, c in got.groupby("chain_id"):
        assert list(c["pos"]) == list(range(len(c))) and list(c["v"])[:-1] == list(c["u"])[1:]
        if not c["closed"].any():
            assert key(list(c["edge_id"])) in {key(w) for w in want}


def test_chain_geometry_and_points(spark):
    nodes = spark.createDataFrame([(i, float(i * 10), 0.0) for i in range(4)], "node_id int, x double, y double")
    edges = spark.createDataFrame([(1, 0, 1, [(0.0, 0.0), (5.0, 5.0), (10.0, 0.0)]), (2, 2, 1, [(20.0, 0.0), (15.0, 2.0), (10.0, 0.0)]), (3, 2, 3, None)], "edge_id int, u int, v int, geometry array<struct<x:double,y:double>>")
    chains = graph.chain_decompose(edges.select("edge_id", "u", "v", F.lit(1.0).alias("length"), F.lit("n").alias("name")))
    g = graph.chain_geometry(chains, nodes, edges).first()
    assert [(p.x, p.y) for p in g.geometry] == [(0, 0), (5, 5), (10, 0), (15, 2), (20, 0), (30, 0)]
    seg = spark.createDataFrame([(1, 100.0), (2, 0.5), (3, 60.0)], "segment_id int, length double")
    d = sampling.sample_along(seg, 30.0).groupBy("segment_id").agg(F.array_sort(F.collect_list("distance")).alias("d")).orderBy("segment_id").collect()
    assert [r.d for r in d] == [[0, 30, 60, 90, 100], [0, 0.5], [0, 30, 60]]


def test_sequence_ids_and_greedy(spark):
    rows = [(i % 37, i, float(i % 11), float(i % 7), f"p{i % 50}") for i in range(500)]
    df = spark.createDataFrame(rows, "run int, idx int, latitude double, longitude double, pano_id string")
    got = graph.sequence_ids(df, ["run", "idx"], "n", pattern="%04d").orderBy("n").collect()
    assert [r.n for r in got] == [f"{i:04d}" for i in range(500)] and [(r.run, r.idx) for r in got] == sorted((r[0], r[1]) for r in rows)
    walk = nearest.greedy_nearest_order(df.withColumn("run", F.lit(1)), "run").orderBy("visit").collect()
    assert len(walk) == 50 == len({r.pano_id for r in walk}) and walk[0].idx == 0


def test_nth_longest_edge(spark):
    e = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 7.0)], "edge_id int, length double")
    assert sampling.nth_longest_edge(e, 1).first().edge_id == 3
    with pytest.raises(Exception, match="no edge at 3"):
        sampling.nth_longest_edge(e, 3).collect()


# ---------------------------------------------------------------- rectification


def test_rectify_equals_pixelwise_warp(spark):
    h, w = 60, 80
    grid = np.zeros((h, w), bool)
    for r in range(20, 60):
        grid[r, int(30 - 0.4 * (r - 20)) : int(45 + 0.5 * (r - 20))] = True
    ob = np.zeros((h, w), bool)
    ob[35:50, 30:38] = True
    m = grid_runs(spark, {(1, "sidewalk_0", "sidewalk"): grid, (1, "tree_0", "tree"): ob})
    edges = raster.row_edges(m.where("class_name = 'sidewalk'"), w)
    fit = raster.edge_fit(edges)
    rect, dims = raster.rectify_masks(m, raster.assign_obstacles(m), raster.extrapolate_edges(edges, fit), None, w, h)
    d = dims.first()
    rows = np.flatnonzero(grid.any(axis=1))
    left, right = np.array([grid[r].argmax() for r in rows]), np.array([w - 1 - grid[r][::-1].argmax() for r in rows])
    ok = (left >= 3) & (right < w - 3)
    la, lb = np.polyfit(rows[ok], left[ok], 1)
    ra, rb = np.polyfit(rows[ok], right[ok], 1)
    rows_all = rows[ok] if not (~ok).any() else rows
    first, last = rows_all[0], rows_all[-1]
    vl = np.where(left < 3, la * rows + lb, left)
    vr = np.where(right >= w - 3, ra * rows + rb, right)
    tw = round(float(np.median(vr - vl)))
    assert d.target_w == tw and d.pad == int(tw * 0.3)
    la, lb = np.polyfit(rows, vl, 1)
    ra, rb = np.polyfit(rows, vr, 1)
    vy = (rb - lb) / (la - ra)
    scale = np.ones(h)
    for r in range(first, last + 1):
        scale[r] = min((abs(last - vy) / abs(r - vy)) ** 2, 6)
    cum = np.cumsum(scale) - scale[0]
    out_h = int(np.ceil(cum[-1])) + 1
    src = np.interp(np.arange(out_h), cum, np.arange(h))
    want = np.zeros((out_h, tw + 2 * d.pad), bool)
    for o in range(out_h):
        lo, hi = la * src[o] + lb, ra * src[o] + rb
        if hi <= lo:
            continue
        x = np.rint(lo + (np.arange(want.shape[1]) - d.pad) * (hi - lo) / tw).astype(int)
        y = int(np.rint(src[o]))
        inside = (x >= 0) & (x < w) & (0 <= y < h)
        want[o, inside] = ob[y, x[inside]]
    got = paint(rect.where("mask_key = 'tree_0'").select("out_r", "o0", "o1").collect(), want.shape)
    assert (got != want).mean() < 0.01 and want.sum() > 50
    prints, filled = raster.estimate_footprint(rect, dims)
    p = prints.first()
    assert p.is_tree and 0 <= p.fp_left < p.fp_right <= d.out_width and p.fp_bottom - p.fp_top <= 25
    meta = raster.footprint_metadata(rect, filled, dims).first()
    assert meta.method == "trunk" and meta.footprint_area_px == (p.fp_right - p.fp_left) * (p.fp_bottom - p.fp_top)


def test_estimate_width_statuses(spark):
    rows = [(1, "sidewalk_0", "sidewalk", r, 100 - r // 8, 200 + r // 8) for r in range(250, 400)] + [(2, "sidewalk_0", "sidewalk", 300, 0, 639)]
    m = spark.createDataFrame(rows, "image_id int, mask_key string, class_name string, r int, c0 int, c1 int")
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id int")
    got = {r.image_id: r for r in raster.estimate_width(m, images).collect()}
    assert (got[1].status, got[2].status, got[3].status) == ("ok", "no_valid_edges", "no_sidewalk_mask")
    used = [(r, 1.8 * ((200 + r // 8) - (100 - r // 8)) / (r - 240) * 100) for r in range(261, 400)]
    q1, q3 = np.percentile([x for _, x in used], [25, 75])
    ok = [x for _, x in used if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
    assert got[1].median_cm == pytest.approx(np.median(ok)) and got[1].std_cm == pytest.approx(np.std(ok)) and got[1].rows_used == len(ok)


# ---------------------------------------------------------------- point clouds


def test_plane_and_across(spark):
    rng = np.random.default_rng(1)
    n = np.array([0.1, 0.95, -0.2])
    n /= np.linalg.norm(n)
    a = np.cross(n, [1, 0, 0])
    a /= np.linalg.norm(a)
    b = np.cross(n, a)
    pts = rng.uniform(-3, 3, (800, 1)) * a + rng.uniform(-3, 3, (800, 1)) * b + rng.normal(0, 0.004, (800, 1)) * n - 1.5 * n
    pts = np.vstack((pts, rng.uniform(-3, 3, (150, 3))))
    df = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(pts)], "image_id int, pt long, x double, y double, z double")
    p = cloud.fit_ground_plane(df, iters=60).first()
    got = np.array([p.nx, p.ny, p.nz])
    assert abs(got @ n) > 0.9999 and abs(abs(p.d) - 1.5) < 0.01 and p.refined
    few = df.where("pt < 20")
    assert cloud.fit_ground_plane(few, iters=5).count() == 0
    cov = np.cov(pts.T, bias=True)
    coarse = cloud.fit_plane(df, ["image_id"]).first()
    assert abs(np.array([coarse.nx, coarse.ny, coarse.nz]) @ np.linalg.eigh(cov)[1][:, 0]) > 1 - 1e-9
    s = cloud.metric_scale(spark.createDataFrame([(1, 0.0, 1.0, 0.0, -2.0)], "image_id int, nx double, ny double, nz double, d double"), spark.createDataFrame([(1, 0.0, 3.0, 0.0)], "image_id int, cx double, cy double, cz double"), 1.8).first()
    assert s.scale == pytest.approx(1.8) and s.reason is None


def test_bilinear(spark):
    grid = np.arange(20.0).reshape(4, 5)
    c = spark.createDataFrame([(1, r, k, float(grid[r, k]), 0.0, 1.0) for r in range(4) for k in range(5)], "image_id int, yd int, xd int, x double, y double, z double")
    at = spark.createDataFrame([(1, 0, 1.5, 2.25), (1, 1, 4.0, 3.0)], "image_id int, pt int, xs double, ys double")
    got = {r.pt: r.x for r in cloud.bilinear_sample(c, at, 4, 5).collect()}
    assert got == {0: pytest.approx(2.25 * 5 + 1.5), 1: pytest.approx(19)}


def close3(g: np.ndarray) -> np.ndarray:
    def around(x, pad, fn):
        p = np.pad(x, 1, constant_values=pad)
        return fn([p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3)])

    return around(around(g, False, lambda s: np.any(s, axis=0)), True, lambda s: np.all(s, axis=0))


def test_clean_label_mask(spark):
    rng = np.random.default_rng(2)
    g = np.zeros((60, 80), bool)
    g[20:40, 10:70] = rng.random((20, 60)) < 0.8
    g[2:5, 2:5] = True  # too small
    g[50:60, 0:12] = True
    g[1:9, 66:79] = True  # a row and a column from the border
    x, y0, y1 = readers.line_runs(g.T)
    df = spark.createDataFrame([(1, "sidewalk", int(a), int(b), int(c)) for a, b, c in zip(x, y0, y1, strict=True)], "image_id int, label string, x int, y0 int, y1 int")
    want = g.copy()
    for comp in flood(g):
        if len(comp) < 50:
            for p in comp:
                want[p] = False
    want = close3(want)
    got = paint([(r.x, r.y0, r.y1) for r in cloud.clean_label_mask(df, 80, 60).collect()], (80, 60)).T
    assert (got == want).all()


def test_measure_width_of_a_flat_street(spark):
    h, w, hd, wd = 120, 160, 60, 80
    f = (h / 2) / np.tan(0.5)
    xs, ys = np.meshgrid(np.arange(wd) * (w - 1) / (wd - 1), np.arange(hd) * (h - 1) / (hd - 1))
    far = np.where(ys > h / 2 + 1, 1.8 * f / np.maximum(ys - h / 2, 1e-6), np.nan)
    cloud_rows = [(1, int(r), int(c), float((xs[r, c] - w / 2) / f * far[r, c]), 1.8, float(far[r, c])) for r in range(hd) for c in range(wd) if np.isfinite(far[r, c])]
    points = spark.createDataFrame(cloud_rows, "image_id int, yd int, xd int, x double, y double, z double")
    near, away = 4.0, 6.5  # a band across the view, 2.5 m deep
    y0, y1 = int(h / 2 + 1.8 * f / away), int(h / 2 + 1.8 * f / near)
    labels = spark.createDataFrame([(1, "sidewalk", x, y0, y1) for x in range(w)] + [(1, "road", x, y1 + 1, h - 1) for x in range(w)], "image_id int, label string, x int, y0 int, y1 int")
    pose = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 0.0, 1.0)], "image_id int, cx double, cy double, cz double, fov double")
    got = {r.image_id: r for r in cloud.measure_width_points(labels, points, pose, (h, w), (hd, wd), iters=20, min_run_px=5).collect()}
    assert got[1].reason == "" and got[1].width_m == pytest.approx(2.5, abs=0.35)
    assert got[2].width_m is None and got[2].reason != ""
    docs, summary = cloud.alt_width_batch(pose.select("image_id"), spark.createDataFrame([(1, 2.5, 9, "")], "image_id int, width_m double, n_cols long, reason string"))
    s = summary.first()
    assert (s.total, s.ok, s.failed, s.reasons) == (2, 1, 1, {"E:missing": 1})


# ---------------------------------------------------------------- tables


def test_detection_summary_golden(spark):
    d = spark.createDataFrame([(1, 0, "sidewalk", 0.8008, 0.0, 0.0, 10.0, 10.0, 36673), (1, 1, "sidewalk", 0.5508, 0.0, 0.0, 9.0, 9.0, 1891), (1, 2, "sidewalk", 0.5, 0.0, 0.0, 1.0, 1.0, 5)], "image_id int, idx int, prompt string, confidence double, x1 double, y1 double, x2 double, y2 double, mask_pixels long")
    s = {r.image_id: r for r in detect.detection_summary(d, spark.createDataFrame([(1,), (2,)], "image_id int"), spark.createDataFrame([(1, 38564)], "image_id int, union_px long"), 640, 640).collect()}
    assert (s[1].detection_count, s[1].mean_confidence, s[1].total_segmented_ratio) == (2, 0.6758, 0.09415) and len(s[1].detections) == 2
    assert s[2].detection_count == 0 and s[2].mean_confidence is None
    assert detect.batch_summary(spark.createDataFrame([], "detection_count long, total_segmented_ratio double")).first().avg_ratio == 0


def test_detection_summary_is_of_the_masks_that_were_kept(spark):
    d = spark.createDataFrame([(1, 1, "a", 0.8, 10), (1, 0, "b", 0.9, 8), (1, 2, "c", 0.5, 90), (1, 3, "b", 0.6, 8), (2, 0, "a", 0.2, 5)], "image_id int, idx int, mask_key string, confidence double, mask_pixels long")
    d = d.selectExpr("*", "0.0D AS x1", "0.0D AS y1", "1.0D AS x2", "2.0D AS y2")
    masks = spark.createDataFrame([(1, "a", 0, 0, 9), (1, "b", 0, 5, 12), (1, "c", 0, 40, 99), (2, "a", 0, 0, 4), (3, "a", 0, 0, 4)], "image_id int, mask_key string, r int, c0 int, c1 int")
    union = runs.mask_union_area(detect.detected_masks(d, masks))
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id int")
    got = {r.image_id: r for r in detect.detection_summary(d, images, union, 10, 10).collect()}
    assert {i: (r.detection_count, r.total_segmented_pixels) for i, r in got.items()} == {1: (3, 13), 2: (0, 0), 3: (0, 0)}
    assert [x["index"] for x in got[1].detections] == [0, 1, 3] and got[2].detections == []


def test_shares_round_as_their_sql(spark):
    import duckdb

    px = [19296, 19872, 77088, 96, 288, 31136]  # halves of the last place
    want = [r[0] for r in duckdb.sql(f"SELECT round(CAST(unnest({px}) AS DOUBLE) / 307200, 6)").fetchall()]
    masks = spark.createDataFrame([(i, "a", r, 0, min(639, n - 640 * r - 1)) for i, n in enumerate(px) for r in range(-(-n // 640))], "image_id int, mask_key string, r int, c0 int, c1 int")
    got = runs.mask_area(masks, 640, 480).orderBy("image_id").collect()
    assert [r.mask_px for r in got] == px and [r.area_ratio for r in got] == want
    d = spark.createDataFrame([(i, 0.9) for i in range(len(px))], "image_id int, confidence double")
    found = d.selectExpr("*", "0 AS idx", "1L AS mask_pixels", "0.0D AS x1", "0.0D AS y1", "1.0D AS x2", "1.0D AS y2")
    docs = detect.detection_summary(found, d, runs.mask_union_area(masks), 640, 480)
    assert [r.total_segmented_ratio for r in docs.orderBy("image_id").collect()] == want


def test_detection_documents_hold_their_detections(spark):
    from __spark_entry__ import SMOKE_DIR, queries

    got = queries()["detection_summary"](spark, SMOKE_DIR)
    rows = got.collect()
    assert all(len([x for x in r.detections.split(";") if x]) == r.detection_count for r in rows)
    assert len(rows) == spark.read.parquet(f"{SMOKE_DIR}/orders.parquet").count() > got.where("detection_count > 0").count()


def test_resolvers(spark):
    folders = spark.createDataFrame([("7_1.0_1.0", "7", "left"), ("7_2.0_2.0", "7", "left"), ("7_bad_x", "7", "left")], "folder string, point_id string, direction string")
    targets = spark.createDataFrame([(1, "7", "left", "7_2.0_2.0", 1.0, 1.0), (2, "7", "left", "7_9_9", 1.8, 1.8), (3, "7", "left", None, None, None), (4, "8", "left", None, 1.0, 1.0), (5, "8", "left", "8_1_1", 1.0, 1.0)], "target_id int, point_id string, direction string, preferred string, lat double, lon double")
    got = {r.target_id: r.folder for r in resolve.resolve_nearest_folder(targets, folders).collect()}
    assert got == {1: "7_2.0_2.0", 2: "7_2.0_2.0", 3: "7_1.0_1.0", 4: "8_unknown_unknown", 5: "8_1_1"}
    images = spark.createDataFrame([("012", "0007", "forward"), ("1", "2", "left")], "segment_id string, point_id string, direction string")
    manifest = spark.createDataFrame([(12, 7, "forward", "junction")], "segment_id int, point_id int, direction string, point_type string")
    assert [r.point_type for r in resolve.join_point_type(images, manifest).orderBy("segment_id").collect()] == ["junction", "street"]
    assert {r.point_type for r in resolve.join_point_type(images, manifest, strict_text_keys=True).collect()} == {"street"}
    ok, bad = filters.filter_report_valid(spark.createDataFrame([("a", "left", " x "), ("", "left", "x"), ("a", None, "x"), ("a", "left", "  ")], "point_id string, direction string, description string"))
    assert [r.description for r in ok.collect()] == ["x"] and bad.count() == 3


def test_metrics(spark):
    j = evaluate.join_predictions_truth(spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 1.0)], "id int, predicted_width double"), spark.createDataFrame([(1, 2.2), (2, 2.0)], "id int, central_width double"))
    m = evaluate.width_metrics(j).first()
    assert (m.n, m.pct_25cm, m.mae, m.bias) == (2, 50.0, pytest.approx(0.6), pytest.approx(0.4))
    rows = {r.id: r for r in writers.prediction_rows(j).collect()}
    assert rows[3].ground_truth == "" and rows[1].abs_error == "0.2000"


# ---------------------------------------------------------------- files


def test_image_files(spark, tmp_path):
    g = np.zeros((40, 60), np.uint8)
    g[5:20, 10:30] = 255
    g[25, 50] = 128
    g[26, 50] = 127
    d = tmp_path / "7_1_2" / "forward" / "sidewalk"
    d.mkdir(parents=True)
    (d / "mask_000.png").write_bytes(png(g))
    (d / "notes.txt").write_text("x")
    got = readers.scan_mask_runs(spark, str(tmp_path)).collect()
    assert (paint([(r.r, r.c0, r.c1) for r in got], g.shape) == (g > 127)).all() and {r.mask_key for r in got} == {"sidewalk_forward_000"}
    assert readers.scan_image_objects(spark, str(tmp_path)).count() == 1
    runs_ = readers.scan_label_runs(spark, str(tmp_path), {255: "sidewalk"}).collect()
    assert (paint([(r.x, r.y0, r.y1) for r in runs_], g.T.shape).T == (g == 255)).all()


def test_tables_from_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text('point_id,note,uri\n1,"a, b",u\n\n2,x\n3,y,z,extra\n')
    got = readers.scan_manifest_strict(spark, str(tmp_path / "m.csv")).orderBy("line_no").collect()
    assert [(r.point_id, r.note, r.uri) for r in got] == [("1", "a, b", "u"), ("3", "y", "z")]
    (tmp_path / "t.csv").write_text("id,central_width\n1,2.5\nx,3\n2,wide\n1,2.75\n")
    assert [(r.id, r.central_width) for r in readers.scan_ground_truth(spark, str(tmp_path / "t.csv")).collect()] == [(1, 2.75)]
    assert readers.scan_ground_truth(spark, str(tmp_path / "none.csv")).count() == 0
    doc = {"source": "a.jpg", "prompt": "sidewalk", "detection_count": 1, "detections": [{"index": 0, "confidence": 0.5, "bbox_xyxy": [1, 2, 3, 4], "mask_pixels": 9}], "summary": {"mean_confidence": 0.5}}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "docs" / "b.json").write_text(json.dumps({"source": "b.jpg", "detections": []}))
    rows = {r.source: r for r in readers.scan_detection_metadata(spark, str(tmp_path / "docs")).collect()}
    assert rows["a.jpg"].bbox_xyxy == [1, 2, 3, 4] and rows["b.jpg"].confidence is None
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "width_metadata.json").write_text(json.dumps({"segment": "s", "width_cm": {"median": 180.5}, "rows_used": 3}))
    w = readers.scan_width_metadata(spark, str(tmp_path / "w")).first()
    assert w.width_cm.median == 180.5 and w.path.endswith("width_metadata.json")


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"pointId":"p1","direction":"left","description":" hole ","timestamp":"2024-01-02T03:04:05.678Z"}\n{"pointId":"","direction":"left","description":"x"}\n')
    for _ in range(2):  # the second run finds nothing new
        stream_reports(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    good = spark.read.json(f"{tmp_path}/out/reports").collect()
    assert len(good) == 1 and good[0].description == "hole" and good[0].key == "reports/p1/left/2024-01-02T03-04-05-678Z.json"
    assert spark.read.json(f"{tmp_path}/out/rejects").count() == 1


def test_entry():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and set(registry.QUERIES) <= set(q) and len(registry.QUERIES) > 110


# ---------------------------------------------------------------- plans


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_clouds_made_by_explode_are_not_broadcast(spark):
    """The planner takes an exploded table for as small as what it came from."""
    ids = spark.range(4).select(F.col("id").alias("image_id"))
    dense = ids.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("yd")).select("image_id", "yd", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("xd"))
    dense = dense.select("image_id", "yd", "xd", *[(F.col("xd") * k + F.col("yd")).cast("double").alias(c) for k, c in enumerate("xyz")])
    coords = ids.select("image_id", F.lit(1).alias("pt"), F.lit(2.5).alias("xs"), F.lit(3.25).alias("ys"))
    got = cloud.bilinear_sample(dense, coords, 10, 10)
    assert "Broadcast" not in plan(got)
    assert {(r.image_id, r.x, r.y, r.z) for r in got.collect()} == {(i, 3.25, 5.75, 8.25) for i in range(4)}


def test_hypotheses_and_labels_are_not_broadcast(spark):
    ids = spark.range(3).select(F.col("id").alias("image_id"))
    points = ids.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("pt")).select("image_id", "pt", *[(F.xxhash64("pt", F.lit(c)) % 1000 / 100.0).alias(c) for c in "xyz"])
    hyps = cloud.plane_hypotheses(points, 50)
    assert "Broadcast" not in plan(hyps) and hyps.groupBy("image_id").count().collect() != []
    dense = points.select("image_id", F.floor(F.col("pt") / 6).cast("int").alias("yd"), (F.col("pt") % 6).cast("int").alias("xd"), *"xyz")
    runs_ = ids.select("image_id", F.lit("road").alias("label"), F.lit(2).alias("x"), F.lit(0).alias("y0"), F.lit(3).alias("y1"))
    ground = cloud.gather_ground(dense, runs_, (6, 6), (6, 6), least=1)
    assert "Broadcast" not in plan(ground) and ground.count() == 3 * 4


def test_components_broadcast_no_table_of_numbers(spark, monkeypatch):
    seen = []
    keep = graph.Scope.settle

    def settled(self, df, name="step"):
        seen.append((name, plan(df)))
        return keep(self, df, name)

    monkeypatch.setattr(graph.Scope, "settle", settled)
    pairs = spark.range(300).where("id % 10 <> 9").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.id: r.comp_id for r in graph.connected_components(pairs).collect()}
    assert got == {i: i // 10 * 10 for i in range(300)}
    assert {n for n, _ in seen} == {"edges", "pointers", "labels"} and not [n for n, p in seen if "Broadcast" in p]


def test_nearest_folder_meets_folders_as_arrays(spark, monkeypatch):
    """Against a plain loop, with more folders than a row holds, ties, a repeated target and one without a place; rows aren't multiplied by folders."""
    rng = random.Random(11)
    at = sorted({(f"{p}_{rng.randint(0, 4)}.5_{rng.randint(0, 4)}.5", str(p), d) for p in range(4) for d in ("left", "right") for _ in range(9)} | {("0_x_y", "0", "left")})
    wants = [(i, str(rng.randint(0, 5)), rng.choice(("left", "right")), rng.choice([None, at[rng.randrange(len(at))][0]]), *rng.choice([(None, None), (rng.uniform(0, 5), rng.uniform(0, 5)), (2.0, 2.0)])) for i in range(120)]
    wants.append(wants[0])
    folders = spark.createDataFrame(at + at[:5], "folder string, point_id string, direction string")
    targets = spark.createDataFrame(wants, "target_id int, point_id string, direction string, preferred string, lat double, lon double")

    def far(folder: str, lat: float | None, lon: float | None) -> float:
        if lat is None:
            return 0.0
        _, la, lo = folder.split("_")
        return float("inf") if la == "x" else (float(la) - lat) ** 2 + (float(lo) - lon) ** 2

    want = {}
    for i, p, d, preferred, lat, lon in wants:
        mine = [f for f, fp, fd in at if (fp, fd) == (p, d)]
        best = min(mine, key=lambda f: (f != preferred, far(f, lat, lon), f), default=None)
        want[i] = (best or preferred or f"{p}_unknown_unknown", best is not None)
    for most in (2, 1000):
        monkeypatch.setattr(resolve, "PLACES", most)
        got = resolve.resolve_nearest_folder(targets, folders).collect()
        assert len(got) == 120 and {r.target_id: (r.folder, r.found) for r in got} == want
