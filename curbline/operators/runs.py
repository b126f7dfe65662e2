"""Interval algebra on run-length rows: runs of flags, unions, differences, layers.

A run has inclusive ends (c0, c1) in a line given by the key columns. Lines are partitions, so work spreads
over images and rows and no run meets one of another line."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .filters import first_per


def runs_from_flags(df: DataFrame, keys: list[str], pos: str, flag: str) -> DataFrame:
    """Stretches of consecutive positions whose flag is true: start (inclusive) and end (exclusive)."""
    island = F.col(pos) - F.row_number().over(W.partitionBy(*keys).orderBy(pos))
    return df.where(F.col(flag)).withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(pos).alias("run_start"), (F.max(pos) + 1).alias("run_end")).drop("_i")


def merge_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Union of overlapping or touching runs of a line: of each island the last row stays, with the column where the island began and the
    farthest reached. One sort does it, and no table of islands is held."""
    order = W.partitionBy(*keys).orderBy("c0", "c1")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    before = F.max("c1").over(order.rowsBetween(W.unboundedPreceding, -1))
    first = F.coalesce(before.isNull() | (F.col("c0") > before + 1), F.lit(False))
    rows = runs.select(*keys, "c0", "c1").withColumn("_f", first)
    rows = rows.select(*keys, F.max(F.when(F.col("_f"), F.col("c0"))).over(upto).alias("c0"), F.max("c1").over(upto).alias("c1"), F.lead("_f").over(order).alias("_next"))
    return rows.where(F.coalesce("_next", F.lit(True))).drop("_next")


def merged_runs(key: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of overlapping or touching runs of equal keys."""
    order = np.lexsort((c1, c0, key))
    key, c0, c1 = key[order], c0[order], c1[order]
    wide = np.int64(max(int(c1.max(initial=0)) - int(c0.min(initial=0)) + 3, 3))
    place = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) * wide if len(key) else key
    reach = np.maximum.accumulate(c1 + place)
    first = np.flatnonzero(np.concatenate(([True], c0[1:] + place[1:] > reach[:-1] + 1))) if len(key) else np.empty(0, np.int64)
    return key[first], c0[first], np.maximum.reduceat(c1, first) if len(first) else c1


def changes(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether each row has other keys than the row before; true for the first."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = table[k].combine_chunks() if isinstance(table[k], pa.ChunkedArray) else table[k]
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return new


def in_whole_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table], pa.Table], fields: str) -> DataFrame:
    """``work`` over tables of rows sorted by the keys and ``order``, in which each group of equal keys is whole. A table holds as many
    groups as come in an Arrow batch, so small groups cost no call each; one larger than a batch is gathered first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # the last group so far

        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts:
                yield from work(pa.Table.from_batches(parts).combine_chunks()).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(np.flatnonzero(changes(batch, keys))[-1])
            if last or (kept and any(kept[0][k][0] != batch[k][0] for k in keys)):
                yield from done(kept + [batch.slice(0, last)] * (last > 0))
                kept = []
            kept.append(batch.slice(last))
        yield from done(kept)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, fields)


def run_events(runs: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """+1 where a run begins and -1 after its end, in the column ``weight``."""
    return runs.select(*keys, F.explode(F.array(F.struct(F.col("c0").alias("x"), F.lit(1).alias("d")), F.struct((F.col("c1") + 1).alias("x"), F.lit(-1).alias("d")))).alias("_e")).select(*keys, F.col("_e.x").alias("x"), F.col("_e.d").alias(weight))


def subtract_runs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of a's runs that no run of b covers: a sweep over the ends of both."""
    events = run_events(a, keys, "a").withColumn("b", F.lit(0)).unionByName(run_events(b, keys, "b").withColumn("a", F.lit(0)))
    events = events.groupBy(*keys, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = W.partitionBy(*keys).orderBy("x")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    spans = events.select(*keys, F.col("x").alias("c0"), (F.lead("x").over(order) - 1).alias("c1"), F.sum("a").over(upto).alias("a"), F.sum("b").over(upto).alias("b"))
    return merge_runs(spans.where((F.col("a") > 0) & (F.col("b") == 0)), keys)


def left_over(line: np.ndarray, c0: np.ndarray, c1: np.ndarray, takes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, first and last column of what runs cover and runs that take away don't: one sweep over all lines, as sums over sorted ends."""
    wide = np.int64(int(c1.max(initial=0)) - int(min(c0.min(initial=0), 0)) + 3)
    base = line.astype(np.int64) * wide
    x = np.concatenate((base + c0, base + c1 + 1))
    sign = np.concatenate((np.ones(len(c0), np.int64), -np.ones(len(c0), np.int64)))
    both = np.concatenate((takes, takes))
    order = np.argsort(x, kind="stable")
    x = x[order]
    covered, taken = np.cumsum((sign * ~both)[order]), np.cumsum((sign * both)[order])
    here = np.flatnonzero((covered[:-1] > 0) & (taken[:-1] == 0) & (x[:-1] < x[1:]))
    begin, end = x[here], x[here + 1] - 1
    joins = begin[1:] == end[:-1] + 1
    first, last = np.append(True, ~joins)[: len(begin)], np.append(~joins, True)[: len(begin)]
    begin, end = begin[first], end[last]
    low = np.int64(min(int(c0.min(initial=0)), 0))
    row = (begin - low) // wide
    return row, begin - row * wide, end - row * wide


def usable_sidewalk(mask_runs: DataFrame, assignment: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sidewalk runs less the union of the obstacles assigned to each, and the area of what is left.

    mask_runs: image_id, mask_key, class_name, r, c0, c1; assignment: image_id, obstacle_key, sidewalk_key. Runs are read once and come
    together by sidewalk, where one sweep over the ends takes the obstacles away."""
    own = F.col("class_name") == "sidewalk"
    of = assignment.select("image_id", F.col("obstacle_key").alias("mask_key"), F.col("sidewalk_key").alias("_of"))
    rows = mask_runs.join(of, ["image_id", "mask_key"], "left").select("image_id", F.when(own, F.col("mask_key")).otherwise(F.col("_of")).alias("sidewalk_key"), *[F.col(c).cast("int").alias(c) for c in ("r", "c0", "c1")], (~own).alias("takes"))
    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("image_id", "sidewalk_key")}

    def sweep(table: pa.Table) -> pa.Table:
        r, c0, c1, takes = (table[c].to_numpy() for c in ("r", "c0", "c1", "takes"))
        made = left_over(r, c0, c1, takes.astype(bool))
        keys = table.select(["image_id", "sidewalk_key"]).take(pa.array(np.zeros(len(made[0]), np.int64)))
        for n, v in zip(("r", "c0", "c1"), made, strict=True):
            keys = keys.append_column(n, pa.array(v.astype(np.int32)))
        return keys

    fields = ", ".join(f"{n} {k}" for n, k in kinds.items())
    left = rows.where("sidewalk_key is not null").groupBy("image_id", "sidewalk_key").applyInArrow(sweep, f"{fields}, r int, c0 int, c1 int")
    return left, left.groupBy("image_id", "sidewalk_key").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("usable_px"))


def mask_area(mask_runs: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels of each mask (overlapping runs count once) and the share of the image."""
    merged = merge_runs(mask_runs, ["image_id", "mask_key", "r"])
    px = F.sum(F.col("c1") - F.col("c0") + 1)
    return merged.groupBy("image_id", "mask_key").agg(px.alias("mask_px"), (F.round(px / (width * height) * 1e6) / 1e6).alias("area_ratio"))


def mask_union_area(mask_runs: DataFrame) -> DataFrame:
    return merge_runs(mask_runs, ["image_id", "r"]).groupBy("image_id").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("union_px"))


def layer_sweep(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(c0, c1, place) of the last-drawn run at each column; runs are (c0, c1, draw order, place). A sweep from left to right that
    carries the open runs in a heap, so that a line of k runs costs k log k."""
    out: list[tuple[int, int, int]] = []
    open_runs: list[tuple[int, int, int]] = []
    todo = sorted(runs)
    at = i = 0
    while i < len(todo) or open_runs:
        if not open_runs:
            at = max(at, todo[i][0])
        while i < len(todo) and todo[i][0] <= at:
            heapq.heappush(open_runs, (-todo[i][2], todo[i][1], todo[i][3]))
            i += 1
        while open_runs and open_runs[0][1] < at:
            heapq.heappop(open_runs)
        if not open_runs:
            continue
        _, end, place = open_runs[0]
        if i < len(todo):
            end = min(end, todo[i][0] - 1)
        out.append((at, end, place))
        at = end + 1
    return out


def silhouette_layers(layers: DataFrame) -> DataFrame:
    """Runs of the last-drawn layer at each pixel. layers: image_id, r, c0, c1, layer, draw_order (one per layer).

    Each image's rows come together once; a sweep over each row's runs keeps what is on top."""
    kinds = {n: layers.schema[n].dataType.simpleString() for n in ("image_id", "r", "layer")}

    def top(table: pa.Table) -> pa.Table:
        table = table.sort_by("r")
        r = table["r"].to_numpy()
        columns = zip(table["c0"].to_pylist(), table["c1"].to_pylist(), table["draw_order"].to_pylist(), range(len(r)), strict=True)
        rows, names = list(columns), table["layer"].to_pylist()
        lines = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))).tolist() if len(r) else []
        made: list[tuple[int, int, int]] = []
        for a, b in pairwise([*lines, len(r)]):
            last = None
            for c0, c1, place in layer_sweep(rows[a:b]):
                if last is not None and names[last[2]] == names[place] and last[1] + 1 == c0:
                    last = made[-1] = (last[0], c1, place)
                else:
                    last = (c0, c1, place)
                    made.append(last)
        places = pa.array([p for _, _, p in made], pa.int64())
        picked = table.select(["image_id", "r", "layer"]).take(places)
        return picked.append_column("c0", pa.array([c for c, _, _ in made], pa.int32())).append_column("c1", pa.array([c for _, c, _ in made], pa.int32()))

    rows = layers.select("image_id", "r", F.col("c0").cast("int"), F.col("c1").cast("int"), "layer", F.col("draw_order").cast("long")).where("c0 <= c1")
    fields = ", ".join(f"{n} {k}" for n, k in kinds.items())
    return rows.groupBy("image_id").applyInArrow(top, f"{fields}, c0 int, c1 int")


def pixels_to_runs(pixels: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Runs of set pixels, with inclusive ends."""
    out = runs_from_flags(pixels.withColumn("_set", F.lit(True)), keys, pos, "_set")
    return out.select(*keys, F.col("run_start").alias("c0"), (F.col("run_end") - 1).alias("c1"))


def best_run_per_column(label_runs: DataFrame, centers: DataFrame, min_run_px: int = 15) -> DataFrame:
    """Of each column the run with the highest length over 1 + distance to the centre / 50, first on ties."""
    rows = label_runs.join(centers, "image_id")
    length = F.col("y1") - F.col("y0") + 1
    mid = (F.col("y0") + F.col("y1") + 1) / 2.0
    score = length / (1.0 + F.abs(mid - F.col("y_center")) / 50.0)
    rows = rows.where(length >= min_run_px).withColumn("score", score)
    return first_per(rows, ["image_id", "x"], [F.desc("score"), F.col("y0")]).select("image_id", "x", "y0", "y1", "score")
