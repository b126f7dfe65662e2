"""Greedy nearest order of points: an exact search in a grid whose points go as they are visited."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_CELL = 2


def distances(lat: np.ndarray, lon: np.ndarray, at: int, others: np.ndarray) -> np.ndarray:
    """Haversine angles (halved) from one point to others, in radians."""
    h = np.sin((lat[others] - lat[at]) / 2) ** 2 + np.cos(lat[at]) * np.cos(lat[others]) * np.sin((lon[others] - lon[at]) / 2) ** 2
    return np.arcsin(np.sqrt(np.minimum(h, 1)))


class Grid:
    """Points still free, in cells of equal size in latitude and longitude."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, free: np.ndarray) -> None:
        self.lat, self.lon, self.built = lat, lon, len(free)
        side = max(1, int(np.sqrt(len(free) / PER_CELL)))
        self.low = lat[free].min(), lon[free].min()
        spans = np.ptp(lat[free]), np.ptp(lon[free])
        self.size = [max(s / side, 1e-12) for s in spans]
        self.side = side
        self.wraps = spans[1] > np.pi  # the short way may lead around: no bound by longitude then
        self.cos_low = float(np.cos(np.abs(lat[free]).max()))
        cells = np.stack([np.minimum((v[free] - lo) / s, side).astype(np.int64) for v, lo, s in zip((lat, lon), self.low, self.size, strict=True)])
        order = np.lexsort((cells[1], cells[0]))
        key = cells[:, order]
        first = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
        self.cells = {(int(r), int(c)): part for (r, c), part in zip(key[:, first].T, np.split(free[order], first[1:]), strict=True)}

    def nearest(self, at: int, is_free: np.ndarray, remaining: int) -> int:
        """The nearest free point, the first of equally near ones."""
        row, col = (int(np.floor((v[at] - lo) / s)) for v, lo, s in zip((self.lat, self.lon), self.low, self.size, strict=True))
        best, best_at, ring, seen = np.inf, -1, 0, 0
        while True:
            found = []
            for r in range(row - ring, row + ring + 1):
                step = 1 if abs(r - row) == ring else max(1, 2 * ring)
                for c in range(col - ring, col + ring + 1, step):
                    seen += 1
                    part = self.cells.get((r, c))
                    if part is not None:
                        part = part[is_free[part]]
                        if len(part):
                            self.cells[r, c] = part
                            found.append(part)
                        else:
                            del self.cells[r, c]
            if found:
                others = np.concatenate(found)
                d = distances(self.lat, self.lon, at, others)
                near = d.min()
                if near <= best:
                    first = int(others[d == near].min())
                    best_at = first if near < best else min(best_at, first)
                    best = near
            # whatever lies beyond this ring is at least ``ring`` cells away in one of the two directions
            away = ring * self.size[0] / 2
            if not self.wraps:
                across = np.sin(min(ring * self.size[1] / 2, np.pi / 2)) * np.sqrt(max(0.0, float(np.cos(self.lat[at])) * self.cos_low))
                away = min(away, float(np.arcsin(min(1.0, across))))
            elif ring <= 2 * self.side:
                away = -1.0
            if away * (1 - 1e-9) > best:
                return best_at
            ring += 1
            if seen > 4 * remaining + 64 or ring > 2 * self.side + 2:  # few points far apart: look at all
                others = np.concatenate(list(self.cells.values()))
                others = others[is_free[others]]
                d = distances(self.lat, self.lon, at, others)
                return int(others[d == d.min()].min())


def greedy_order(lat: np.ndarray, lon: np.ndarray, panos: np.ndarray) -> np.ndarray:
    """Places in the order of visits: from the first always the nearest point whose panorama (a code) is new. About n log n:
    the grid is made anew whenever half of its points are gone."""
    lat, lon = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float))
    by_pano = np.argsort(panos, kind="stable")
    starts = np.searchsorted(panos[by_pano], np.arange(panos.max(initial=-1) + 2))
    free, order, at, remaining = np.ones(len(lat), bool), [], 0, len(lat)
    grid = None
    while True:
        order.append(at)
        same = by_pano[starts[panos[at]] : starts[panos[at] + 1]]
        remaining -= int(free[same].sum())
        free[same] = False
        if not remaining:
            return np.array(order)
        if grid is None or remaining * 2 < grid.built:
            grid = Grid(lat, lon, np.flatnonzero(free))
        at = grid.nearest(at, free, remaining)


def greedy_nearest_order(points: DataFrame, run_key: str, tile_deg: float | None = None) -> DataFrame:
    """Each run's points in greedy order, with ``visit`` from 0: from its first (by idx) always the nearest point whose panorama is new.

    The order is sequential inside a run by its definition, so a run is one task's work, of about n log n. With ``tile_deg`` runs of
    any length are spread: panoramas are first reduced to the first point of each (by idx), a run is parted into square tiles of
    that many degrees, each tile is walked by itself, and tiles follow one another along a Z-order curve; the column ``tile`` says which. Points
    without a position can't be walked and stay out; a null panorama is one panorama."""
    schema = points.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    placed = points.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & ~F.isnan("latitude") & ~F.isnan("longitude"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable").reset_index(drop=True)
        codes = pd.factorize(pdf["pano_id"], use_na_sentinel=False)[0]
        order = greedy_order(pdf["latitude"].to_numpy(float), pdf["longitude"].to_numpy(float), codes)
        out = pdf.iloc[order].copy()
        out["visit"] = np.arange(len(order), dtype=np.int32)
        return out

    if tile_deg is None:
        return placed.groupBy(run_key).applyInPandas(walk, f"{fields}, visit int")
    firsts = placed.groupBy(run_key, "pano_id").agg(F.min_by(F.struct(*points.columns), "idx").alias("_p")).select("_p.*")
    bits = [F.floor((F.col(c) + off) / tile_deg).cast("long") for c, off in (("latitude", 90), ("longitude", 180))]
    code = sum((F.shiftleft(F.shiftright(b, i).bitwiseAND(1), 2 * i + j) for i in range(24) for j, b in enumerate(bits)), F.lit(0).cast("long"))
    return firsts.withColumn("tile", code).groupBy(run_key, "tile").applyInPandas(walk, f"{fields}, tile long, visit int")
