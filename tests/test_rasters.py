"""PNG decoding by bit depth, colour type and row filter, broken files as rows, strips and sweeps against plain loops."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest

from curbline.operators import cloud, filters, graph, raster, runs
from curbline.sources import readers
from curbline.sources.png import SIGNATURE, BadImage, decode_png, grey


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(line: np.ndarray, above: np.ndarray, bpp: int, kind: int) -> bytes:
    out = bytearray([kind])
    for i, x in enumerate(line.tolist()):
        a, b, c = int(line[i - bpp]) if i >= bpp else 0, int(above[i]), int(above[i - bpp]) if i >= bpp else 0
        p = a + b - c
        guess = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(p - v))][kind]
        out.append((x - guess) % 256)
    return bytes(out)


def png(pixels: np.ndarray, colour: int, depth: int, palette: np.ndarray | None = None, filters=(0, 1, 2, 3, 4)) -> bytes:
    h, w, n = pixels.shape
    if depth == 16:
        lines = pixels.astype(">u2").reshape(h, -1).view(np.uint8)
    elif depth == 8:
        lines = pixels.reshape(h, -1).astype(np.uint8)
    else:
        bits = (pixels.reshape(h, -1, 1) >> np.arange(depth - 1, -1, -1) & 1).astype(np.uint8)
        lines = np.packbits(bits.reshape(h, -1), axis=1)
    above, raw = np.zeros(lines.shape[1], np.uint8), b""
    for i, line in enumerate(lines):
        raw += filtered(line, above, max(1, n * depth // 8), filters[i % len(filters)])
        above = line
    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def luma(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(int) for k in range(3))
    return (r * 19595 + g * 38470 + b * 7471 + 32768) // 65536


@pytest.mark.parametrize("colour, depth, n", [(c, d, n) for c, n, ds in ((0, 1, (1, 2, 4, 8, 16)), (2, 3, (8, 16)), (3, 1, (1, 2, 4, 8)), (4, 2, (8, 16)), (6, 4, (8, 16))) for d in ds])
def test_png_of_every_kind(colour, depth, n):
    rng = np.random.default_rng(colour * 17 + depth)
    pixels = rng.integers(0, 1 << depth, (23, 19, n))
    palette = rng.integers(0, 256, (1 << depth, 3)).astype(np.uint8) if colour == 3 else None
    data = png(pixels, colour, depth, palette)
    assert (decode_png(data)[0] == pixels).all()
    high = pixels >> 8 if depth == 16 else pixels
    want = {0: lambda: np.minimum(pixels[..., 0], 255) if depth == 16 else pixels[..., 0] * 255 // ((1 << depth) - 1), 2: lambda: luma(high), 3: lambda: luma(palette[pixels[..., 0]]), 4: lambda: high[..., 0], 6: lambda: luma(high)}[colour]()
    assert (grey(data) == want).all()


def test_broken_files_say_why():
    good = png(np.zeros((4, 5, 1), int), 0, 8)
    at = good.index(b"IDAT")
    for data, why in ((b"", "not a PNG"), (b"\xff\xd8\xff", "not a PNG"), (good[:-20], "ends early"), (good[: at + 6] + b"x" + good[at + 7 :], "checksum"), (SIGNATURE + chunk(b"IEND", b""), "no header")):
        with pytest.raises(BadImage, match=why):
            decode_png(data)
    head = struct.pack(">IIBBBBB", 5, 4, 8, 0, 0, 0, 1)
    for body, idat, why in ((head, b"", "interlaced"), (head[:-1] + b"\0", zlib.compress(b"\0"), "too few"), (head[:-1] + b"\0", b"junk", "unpacked"), (head[:8] + b"\x03\x00\0\0\0", b"", "not known")):
        with pytest.raises(BadImage, match=why):
            decode_png(SIGNATURE + chunk(b"IHDR", body) + chunk(b"IDAT", idat) + chunk(b"IEND", b""))


def test_masks_in_colour_and_broken_ones(spark, tmp_path):
    green, dark = np.zeros((6, 8, 3), int), np.zeros((6, 8, 3), int)
    green[2:4, 1:5, 1] = 255  # luma 150
    dark[:, :, 2] = 255  # blue has a luma of 29
    folder = tmp_path / "1_forward" / "sidewalk"
    folder.mkdir(parents=True)
    good = png(green, 2, 8)
    for name, data in (("mask_000.png", good), ("mask_001.png", png(dark, 2, 8)), ("mask_002.png", good[:60]), ("mask_003.PNG", b"x")):
        (folder / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.scan_masks(spark, str(tmp_path)).collect() if r.r is None}
    assert set(got) == {"mask_001.png", "mask_002.png", "mask_003.PNG"} and got["mask_001.png"].error is None and got["mask_001.png"].width == 8
    assert got["mask_002.png"].error == "file ends early" and got["mask_003.PNG"].error == "not a PNG file"
    assert sorted((r.r, r.c0, r.c1) for r in readers.scan_mask_runs(spark, str(tmp_path)).collect()) == [(2, 1, 4), (3, 1, 4)]
    labels = readers.scan_labels(spark, str(tmp_path), {255: "x"})
    assert sorted(r.error is None for r in labels.collect()) == [False, False, True, True]


def test_files_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameReader

    from curbline.sources import readers

    good = png(np.full((2, 3, 1), 200, np.uint8), 0, 8)
    for name in ("a/sidewalk/mask_000.png", "a/road/mask 1%20é.PNG", "a/_x=1/mask_002.png", "a/_gone/mask_003.png", "a/.gone/mask_004.png", "a/road/_mask_005.png", "b/c/d/e/mask_006.png", "top.png", "photo.jpg", "none/empty.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else good)
    (tmp_path / "bare").mkdir()
    root = str(tmp_path)
    theirs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length").collect()
    assert len(theirs) == 6
    one = {r.path for r in readers.scan_masks(spark, f"{root}/top.png").collect()} | {r.path for r in readers.scan_masks(spark, f"{root}/*/sidewalk").collect()}
    assert len(one) == 2  # a file and a pattern are left to Spark's reader
    plain = DataFrameReader.format
    monkeypatch.setattr(DataFrameReader, "format", lambda self, kind: None if kind == "binaryFile" else plain(self, kind))
    monkeypatch.setattr(readers, "FILES_A_TASK", 2)
    for at in (root, f"file://{root}", f"{root}/"):
        assert sorted(map(tuple, readers.scan_image_objects(spark, at).collect())) == sorted(map(tuple, theirs))
    got = readers.scan_mask_runs(spark, root).select("path", "r", "c0", "c1").collect()
    assert sorted(map(tuple, got)) == sorted((r.path, i, 0, 2) for r in theirs if not r.path.endswith("jpg") for i in (0, 1))
    assert readers.scan_masks(spark, f"{root}/bare").count() == 0


def test_sweep_keeps_the_last_drawn_layer():
    rng = random.Random(4)
    for _ in range(300):
        layers = [(c := rng.randint(0, 30), c + rng.randint(0, 12), rng.randint(0, 5), i) for i in range(rng.randint(0, 12))]
        want = {x: max((o for a, b, o, _ in layers if a <= x <= b), default=None) for x in range(45)}
        got = dict.fromkeys(range(45))
        for a, b, place in runs.layer_sweep(layers):
            for x in range(a, b + 1):
                assert got[x] is None
                got[x] = layers[place][2]
        assert got == want


def test_strip_rows_are_those_of_the_tables(spark):
    rows = [(1, "a", -0.4, 38.0, 0.5, 35.0, 40, 20, 59, 25.0, 30.0, 45.0), (2, "b", 0.0, 10.0, 0.0, 50.0, 40, 3, 50, 40.0, 10.0, 50.0), (3, "c", None, None, None, None, 1, 30, 30, 9.0, 4.0, 13.0)]
    df = spark.createDataFrame(rows, "image_id int, mask_key string, a_left double, b_left double, a_right double, b_right double, n_valid int, first_row int, last_row int, _w double, _l double, _r double")
    scale = raster.row_scale_cumsum(df.drop("first_row", "last_row"), df.select("image_id", "mask_key", "first_row", "last_row"), 60)
    found = {}
    for r in raster.rectify_row_map(scale, 60).collect():
        found.setdefault(r.image_id, []).append((r.out_r, round(r.src_r)))
    for r in df.collect():
        line = {**r.asDict(), "_n": r.n_valid, "target_w": 20, "pad": 6}
        out_r, near, _, _ = raster.strip_rows(line, 60)
        assert list(zip(out_r.tolist(), near.tolist(), strict=True)) == sorted(found[r.image_id])


def test_merged_runs_of_arrays():
    rng = np.random.default_rng(2)
    for _ in range(100):
        n = int(rng.integers(0, 12))
        key, c0 = rng.integers(0, 3, n), rng.integers(-3, 20, n)
        c1 = c0 + rng.integers(0, 5, n)
        got = {(int(k), x) for k, a, b in zip(*raster.merged_runs(key, c0, c1), strict=True) for x in range(a, b + 1)}
        assert got == {(int(k), x) for k, a, b in zip(key, c0, c1, strict=True) for x in range(a, b + 1)}
        k, a, b = raster.merged_runs(key, c0, c1)
        assert all(k[i] != k[i + 1] or b[i] + 1 < a[i + 1] for i in range(len(k) - 1))


def test_what_obstacles_leave():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(0, 14))
        line, c0 = rng.integers(0, 3, n), rng.integers(-4, 20, n)
        c1, takes = c0 + rng.integers(0, 6, n), rng.random(n) < 0.4
        cells = lambda keep: {(int(r), x) for r, a, b, t in zip(line, c0, c1, takes, strict=True) if t == keep for x in range(a, b + 1)}
        got = list(zip(*runs.left_over(line, c0, c1, takes), strict=True))
        assert {(int(r), x) for r, a, b in got for x in range(a, b + 1)} == cells(False) - cells(True)
        assert len(got) == len({(r, x) for r, x in cells(False) - cells(True) if (r, x - 1) not in cells(False) - cells(True)})


def test_raster_components_are_mask_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, k, int(r), int(c), int(c + rng.integers(0, 4))) for i in range(30) for k in ("a", None, "b") for r, c in zip(rng.integers(0, 12, 40), rng.integers(0, 60, 40), strict=True)]
    rows += [(99, "snake", r, 0 if r % 4 == 3 else 40 if r % 2 else 0, 0 if r % 4 == 3 else 40) for r in range(200)]  # one long component
    df = spark.createDataFrame(rows, "image_id int, mask_key string, r int, c0 int, c1 int")
    keys = ["image_id", "mask_key"]
    rank = dict(zip(("image_id", "mask_key", "r", "c0", "c1"), range(5), strict=True))

    def sets(found) -> set:
        parts = {}
        for row in found.where("mask_key is not null").collect():
            parts.setdefault((row.image_id, row.mask_key, row.comp_id), set()).add(tuple(row[c] for c in rank))
        return {frozenset(p) for p in parts.values()}

    got = graph.raster_components(df, keys)
    assert sets(got) == sets(graph.mask_components(runs.merge_runs(df, [*keys, "r"]), keys))
    assert got.where("image_id = 99").select("comp_id").distinct().count() == 1 and got.where("mask_key is null").count() > 0


def test_groups_stay_whole_across_arrow_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(400).selectExpr("cast(sqrt(id) as int) as k", "id % 2 as j", "id as v")

        def count(table):
            first = np.flatnonzero(runs.changes(table, ["k", "j"]))
            n = np.diff(np.append(first, table.num_rows))
            return table.select(["k", "j"]).take(first).append_column("n", [n])

        got = runs.in_whole_groups(df, ["k", "j"], ["v"], count, "k int, j long, n long").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, df.groupBy("k", "j").count().collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_footprints_take_few_exchanges_and_no_rounds(spark, monkeypatch):
    """A component is found within its mask's task: no iterations over all links."""
    def dies(*_):
        raise AssertionError("components by rounds")

    monkeypatch.setattr(graph, "connected_components", dies)
    rect = spark.createDataFrame([(1, "s", "tree_0", "tree", r, 4, 9) for r in range(20)] + [(1, "s", "car_0", "car", r, 30, 45) for r in range(8)], "image_id int, sidewalk_key string, mask_key string, class_name string, out_r int, o0 int, o1 int")
    dims = spark.createDataFrame([(1, "s", 40, 12, 64)], "image_id int, sidewalk_key string, target_w int, pad int, out_width int")
    prints, filled = raster.estimate_footprint(rect, dims)
    assert sorted((r.mask_key, r.fp_left, r.fp_top, r.fp_right, r.fp_bottom) for r in prints.collect()) == [("car_0", 29, 0, 45, 8), ("tree_0", 3, 14, 9, 20)]
    assert sorted((r.mask_key, r.footprint_area_px, r.full_silhouette_area_px) for r in raster.footprint_metadata(rect, filled, dims).collect()) == [("car_0", 128, 128), ("tree_0", 36, 120)]


def test_label_gate_sorts_once_and_holds_no_islands(spark, capsys):
    rng = np.random.default_rng(9)
    rows = [(i, k, int(x), int(y), int(y + h)) for i in range(12) for k in ("sidewalk", "road") for x, y, h in zip(rng.integers(300, 320, 300), rng.integers(0, 90, 300), rng.integers(0, 5, 300), strict=True)]
    df = spark.createDataFrame(rows + rows[:500], "image_id int, label string, x int, y0 int, y1 int")
    merged = cloud.merge_label_runs(df)
    want = []
    for i, k, x in {r[:3] for r in rows}:
        _, y0, y1 = runs.merged_runs(*np.array([(0, r[3], r[4]) for r in rows if r[:3] == (i, k, x)]).T)
        want += [(i, k, x, a, b) for a, b in zip(y0.tolist(), y1.tolist(), strict=True)]
    merged.explain()
    plan = capsys.readouterr().out
    assert "Aggregate" not in plan and plan.count("Sort [") == 1
    filters.quality_gate(merged, 640, 480).explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    assert sorted(map(tuple, merged.collect())) == sorted(want)
