"""Chains, orders, nearest walks, planes and junctions against plain code, with hot values, rings and failures."""

from __future__ import annotations

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbline.operators import cloud, graph, nearest, plugins, sampling
from curbline.scratch import Scope, shared_dir


def scratch_tables(spark) -> set[str]:
    folder = shared_dir(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_scope_drops_what_is_not_given(spark):
    before = scratch_tables(spark)
    with Scope(spark) as scratch:
        a, b = scratch.settle(spark.range(5)), scratch.settle(spark.range(3))
        scratch.drop(a)
        assert len(scratch_tables(spark) - before) == 1
        kept = scratch.give(b.withColumn("x", F.lit(1)))
    assert len(scratch_tables(spark) - before) == 1 and kept.count() == 3
    with pytest.raises(ZeroDivisionError), Scope(spark) as scratch:
        scratch.settle(spark.range(5))
        raise ZeroDivisionError
    assert len(scratch_tables(spark) - before) == 1


def test_components_leave_only_their_result(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + rng.randrange(60)) for i in range(80)]
    before = scratch_tables(spark)
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert len(scratch_tables(spark) - before) == 1
    lead = {x: x for e in edges for x in e}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        lead[hi] = lo
    assert {r.id: r.comp_id for r in got.collect()} == {x: find(x) for x in lead}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_long_ring_beside_short_chains(spark):
    ring = [(i, i, (i + 1) % 90) for i in range(90)]
    random.Random(3).shuffle(ring)
    chains = [(1000 + i, 2000 + 2 * i, 2001 + 2 * i) for i in range(40)]
    loop = [(5000, 6000, 6000)]
    df = spark.createDataFrame([(e, u, v, 1.0, None) for e, u, v in ring + chains + loop], "edge_id int, u int, v int, length double, name string")
    before = scratch_tables(spark)
    got = graph.chain_decompose(df).toPandas().sort_values(["chain_id", "pos"])
    assert len(scratch_tables(spark) - before) == 1
    round_ = got[got["closed"]]
    assert list(round_["u"]) == list(range(90)) and list(round_["v"]) == [*range(1, 90), 0] and list(round_["pos"]) == list(range(90))
    straight = got[~got["closed"]]
    assert sorted(straight["edge_id"]) == [e for e, _, _ in chains] and (straight["u"] < straight["v"]).all()
    assert graph.chain_decompose(df.limit(0)).count() == 0


def test_numbers_when_one_value_is_half_of_all_rows(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 1000).cast("int").alias("v"), F.col("id"), F.lit(None).cast("string").alias("note"))
    got = graph.sequence_ids(rows.repartition(6), ["v"], "n", start=5)
    assert got.columns == ["v", "id", "note", "n"]
    pdf = got.toPandas().sort_values("n")
    assert list(pdf["n"]) == list(range(5, 40_005)) and pdf["v"].is_monotonic_increasing and set(pdf["id"]) == set(range(40_000))
    dealt = rows.withColumn("_tie", F.xxhash64("v", "id")).repartitionByRange(8, "v", "_tie").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert dealt.max() < 10_000  # the hot value is in several ranges
    assert graph.sequence_ids(rows.limit(0), ["v"], "n").count() == 0


def plain_walk(lat, lon, panos) -> list[int]:
    lat, lon, free, order, at = np.radians(lat), np.radians(lon), np.ones(len(lat), bool), [], 0
    while True:
        order.append(at)
        free[panos == panos[at]] = False
        left = np.flatnonzero(free)
        if not len(left):
            return order
        at = int(left[np.argmin(nearest.distances(lat, lon, at, left))])


@pytest.mark.parametrize("kind", range(5))
def test_greedy_order_is_the_plain_walk(kind):
    rng = np.random.default_rng(kind)
    for _ in range(25):
        n = int(rng.integers(1, 250))
        lat, lon = {
            0: lambda: (rng.uniform(40, 41, n), rng.uniform(29, 30, n)),
            1: lambda: (rng.integers(0, 6, n) * 0.01 + 41, rng.integers(0, 6, n) * 0.01 + 29),  # many ties
            2: lambda: (rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)),
            3: lambda: (np.where(rng.random(n) < 0.9, 41 + rng.normal(0, 1e-5, n), rng.uniform(30, 50, n)), 29 + rng.normal(0, 1e-3, n)),  # a cluster and far points
            4: lambda: (np.full(n, 41.0), rng.integers(0, 9, n) * 1.0),
        }[kind]()
        panos = np.unique(rng.integers(0, max(1, n // int(rng.integers(1, 4))), n), return_inverse=True)[1]
        assert nearest.greedy_order(lat, lon, panos).tolist() == plain_walk(lat, lon, panos)


def test_greedy_runs_and_tiles(spark):
    rng = np.random.default_rng(9)
    rows = [(i % 3, i, float(41 + rng.random() / 10), float(29 + rng.random() / 10), f"p{i % 70}" if i % 9 else None) for i in range(300)] + [(0, 999, None, 29.0, "x")]
    df = spark.createDataFrame(rows, "run int, idx int, latitude double, longitude double, pano_id string")
    for run in range(3):
        mine = [r for r in rows if r[0] == run and r[2] is not None]
        names = [r[4] for r in mine]
        want = plain_walk(np.array([r[2] for r in mine]), np.array([r[3] for r in mine]), np.array([names.index(x) for x in names]))
        got = nearest.greedy_nearest_order(df, "run").where(F.col("run") == run).orderBy("visit").collect()
        assert [r.idx for r in got] == [mine[i][1] for i in want]
    tiles = nearest.greedy_nearest_order(df, "run", tile_deg=0.03).toPandas()
    assert len(tiles) == len({(r[0], r[4]) for r in rows if r[2] is not None}) and tiles["tile"].nunique() > 5
    for _, t in tiles.groupby(["run", "tile"]):
        t = t.sort_values("visit")
        assert list(t["visit"]) == list(range(len(t))) and t["idx"].iloc[0] == t["idx"].min()
        by_idx = t.sort_values("idx")
        assert list(t["idx"]) == list(by_idx["idx"].to_numpy()[plain_walk(by_idx["latitude"].to_numpy(), by_idx["longitude"].to_numpy(), np.arange(len(t)))])


def test_bent_edges_keep_their_shape(spark):
    nodes = spark.createDataFrame([(1, 41.0, 29.0), (2, 41.01, 29.0)], "node_id int, lat double, lon double")
    shape = "array<struct<lon:double,lat:double>>"
    edge = spark.createDataFrame([(1, 1, 2, 900.0, "s", [(29.0, 41.0), (29.005, 41.01), (29.0, 41.01)])], f"edge_id int, u int, v int, length double, name string, geometry {shape}")
    box = [(40.9, 28.9), (41.1, 28.9), (41.1, 29.1), (40.9, 29.1)]
    got = sampling.sample_polygon(nodes, edge, box, 30.0).toPandas()
    far = max(got["distance_along_m"])
    assert 1600 < far < 1630 and got["longitude"].max() > 29.0049  # the chord alone is 1111 m, due north
    straight = sampling.sample_polygon(nodes, edge.withColumn("geometry", F.lit(None).cast(shape)), box, 30.0).toPandas()
    assert 1105 < max(straight["distance_along_m"]) < 1115 and abs(straight["longitude"] - 29).max() < 1e-6
    back = edge.select("edge_id", F.col("v").alias("u"), F.col("u").alias("v"), "length", "name", F.reverse("geometry").alias("geometry"))
    turned = sampling.sample_polygon(nodes, back, box, 30.0).toPandas()
    assert np.allclose(turned[["latitude", "longitude"]], got[["latitude", "longitude"]], atol=1e-9)


def plane_by_hand(points: np.ndarray, thresh: float, hyps: list[tuple]) -> dict[int, int]:
    return {h: int((np.abs(nx * points[:, 0] + ny * points[:, 1] + nz * points[:, 2] + d) < thresh).sum()) for h, nx, ny, nz, d in hyps}


def test_plane_fit_against_plain_code(spark):
    rng = np.random.default_rng(4)
    flat = np.column_stack((rng.normal(0, 3, 70), rng.normal(0, 0.004, 70), rng.normal(0, 3, 70)))
    cloud_ = np.vstack((flat, rng.normal(0, 3, (31, 3))))  # 101 points: 30 inliers would do
    pts = [(1, i, *map(float, p)) for i, p in enumerate(cloud_)] + [(2, i, float(i), 0.0, 0.0) for i in range(60)] + [(3, i, 0.0, 0.0, 0.0) for i in range(4)]
    df = spark.createDataFrame(pts, "image_id int, pt int, x double, y double, z double")
    hyps = cloud.plane_hypotheses(df, 200)
    found = hyps.where("image_id = 1").collect()
    assert len(found) > 195 and hyps.where("image_id in (2, 3)").count() == 0  # points on a line or in one place give no plane
    for h in found[:20]:
        near = np.abs(cloud_ @ np.array([h.nx, h.ny, h.nz]) + h.d) < 1e-9
        assert near.sum() >= 3  # each goes through three different points
    counts = cloud.plane_inlier_join(df.where("image_id = 1"), hyps, spark.createDataFrame([(1, 0.02)], "image_id int, thresh double"))
    assert {r.hyp: r.inliers for r in counts.collect()} == plane_by_hand(cloud_, 0.02, [(h.hyp, h.nx, h.ny, h.nz, h.d) for h in found])
    got = {r.image_id: r for r in cloud.fit_ground_plane(df, iters=200).collect()}
    assert set(got) == {1} or 2 in got
    p = got[1]
    assert p.refined and abs(p.ny) > 0.9999 and p.inliers >= 70
    floor = cloud.fit_ground_plane(df.where("image_id = 1"), iters=200, min_inlier_ratio=(p.inliers + 0.9) / 101).first()
    assert floor.refined  # the share of 101 points is rounded down


def test_planes_of_whole_images_need_no_table_of_hypotheses(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pts = []
    for image, n in ((1, 90), (2, 130), (3, 60)):
        flat = np.column_stack((rng.normal(0, 3, n), rng.normal(0, 0.004, n), rng.normal(0, 3, n)))
        some = np.vstack((flat, rng.normal(0, 3, (n // 3, 3))))
        pts += [(image, i + (i > 40 and image == 3), *map(float, p)) for i, p in enumerate(some)]  # image 3 has no point 41
    pts += [(1, 7000, None, 0.0, 1.0), (2, 7000, 1.0, None, None)]  # no point of a plane
    df = spark.createDataFrame(pts, "image_id int, pt int, x double, y double, z double")
    blocks = cloud.plane_hypotheses
    monkeypatch.setattr(cloud, "plane_hypotheses", None)
    whole = {r.image_id: r for r in cloud.fit_ground_plane(df, iters=150).collect()}
    assert set(whole) == {1, 2, 3} and all(r.refined for r in whole.values())
    monkeypatch.setattr(cloud, "plane_hypotheses", blocks)
    for most in (0, 121):  # all in blocks; image 2 alone
        monkeypatch.setattr(cloud, "WHOLE", most)
        got = {r.image_id: r for r in cloud.fit_ground_plane(df, iters=150).collect()}
        assert all(np.allclose(got[i][1:6], whole[i][1:6], rtol=0, atol=1e-12) for i in whole) and set(got) == set(whole)


def test_a_cloud_is_cut_to_the_cells_that_are_read(spark):
    runs = spark.createDataFrame([(1, "sidewalk", 4, 3, 5), (1, "road", 7, 0, 11), (1, "tree", 0, 0, 11), (2, "sidewalk", 5, 0, 11)], "image_id int, label string, x int, y0 int, y1 int")
    dense = spark.range(2 * 36).selectExpr("cast(id / 36 as int) + 1 AS image_id", "cast(id % 36 / 6 as int) AS yd", "cast(id % 6 as int) AS xd", "double(id % 7) AS x", "double(id % 5) AS y", "double(id) AS z")
    coords = spark.createDataFrame([(1, 0, 0.5, 4.9), (2, 1, 5.0, 5.0)], "image_id int, pt int, xs double, ys double")
    cells = cloud.wanted_cells(runs, coords, (12, 12), (6, 6))
    assert sorted(map(tuple, cells.collect())) == [(1, 2, 2), (1, 4, 0), (1, 4, 1), (1, 5, 0), (1, 5, 1), (2, 4, 4), (2, 4, 5), (2, 5, 4), (2, 5, 5)]
    some = dense.join(cells, ["image_id", "yd", "xd"], "left_semi")
    for of in (lambda c: cloud.bilinear_sample(c, coords, 6, 6), lambda c: cloud.gather_ground(c, runs, (12, 12), (6, 6), least=1)):
        assert sorted(map(tuple, of(some).collect())) == sorted(map(tuple, of(dense).collect())) != []


def test_masks_are_cleaned_without_rounds_of_joins(spark, monkeypatch):
    from curbline.operators import graph

    monkeypatch.setattr(graph, "connected_components", None)
    rng = np.random.default_rng(6)
    for width in (1, 2, 12):
        grid = rng.random((width, 90)) < 0.93
        rows = [(1, "sidewalk", x, y, y) for x, y in zip(*map(lambda v: v.tolist(), np.nonzero(grid)), strict=True)]
        got = np.zeros_like(grid)
        for r in cloud.clean_label_mask(spark.createDataFrame(rows, "image_id int, label string, x int, y0 int, y1 int"), width, 90).collect():
            got[r.x, r.y0 : r.y1 + 1] = True

        def around(g: np.ndarray, outside: bool) -> np.ndarray:
            p = np.pad(g, 1, constant_values=outside)
            return np.stack([p[i : i + g.shape[0], j : j + g.shape[1]] for i in range(3) for j in range(3)])

        parts, kept = np.where(grid, np.arange(grid.size).reshape(grid.shape) + 1, 0), np.zeros_like(grid)
        while not np.array_equal(new := np.where(grid, around(parts, False).max(axis=0), 0), parts):
            parts = new
        for part in set(parts[grid].tolist()):
            kept |= (parts == part) & ((parts == part).sum() >= 50)
        assert np.array_equal(got, around(around(kept, False).any(axis=0), True).all(axis=0))


def test_junctions_with_and_without_masks_and_failures(spark):
    images = spark.createDataFrame([(1, "a.jpg", "m/1", bytearray(b"\xff\xd8one"), '{"point_id": 5}'), (2, "b.jpg", None, None, None), (3, "c.jpg", "m/3", bytearray(b"x"), "{}")], "image_id int, image_blob string, masks_prefix string, content binary, metadata string")
    runs = spark.createDataFrame([(1, "sidewalk_0", "Sidewalk", 2, 1, 3), (1, "sidewalk_0", "Sidewalk", 3, 1, 4), (1, "tree_0", "tree", 2, 2, 2), (3, "road_0", "road", 0, 0, 9), (9, "road_0", "road", 0, 0, 9)], "image_id int, mask_key string, class_name string, r int, c0 int, c1 int")

    def look(image: plugins.JunctionImage) -> dict:
        if image.image_id == 3:
            raise KeyError("no crossing")
        px = image.raster("sidewalk_0", 6, 8).sum() if image.sidewalks else 0
        return {"px": int(px), "obstacles": sorted(image.obstacles), "bytes": len(image.content or b""), "point": image.metadata.get("point_id")}

    got = {r.image_id: r for r in plugins.junction_analyzer(images, runs, look).collect()}
    assert json.loads(got[1].analysis) == {"px": 7, "obstacles": ["tree_0"], "bytes": 5, "point": 5} and got[1].status == "junction_analyzed"
    assert json.loads(got[2].analysis) == {"px": 0, "obstacles": [], "bytes": 0, "point": None}  # no masks
    assert got[3].status == "E:KeyError" and "no crossing" in got[3].error and got[3].analysis is None and len(got) == 3
    docs = {r.image_id: json.loads(r.document) for r in plugins.junction_documents(plugins.junction_analyzer(images, runs, look)).collect()}
    assert docs[1]["analysis"]["px"] == 7 and docs[1]["metadata"] == {"point_id": 5} and set(docs[1]) == {"status", "image_blob", "masks_prefix", "metadata", "analysis"}
    stub = {r.image_id: json.loads(r.document) for r in plugins.junction_documents(plugins.junction_analyzer(images)).collect()}
    assert stub[2] == {"status": "junction_stub", "image_blob": "b.jpg", "masks_prefix": None, "metadata": {}, "analysis": None}
