"""User functions over all that belongs to an image."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JunctionImage:
    """What an analyzer sees: the image's bytes as stored (None if not read), runs (r, c0, c1) of each sidewalk and obstacle mask, and metadata."""

    image_id: Any
    content: bytes | None
    sidewalks: dict[str, np.ndarray] = field(default_factory=dict)
    obstacles: dict[str, np.ndarray] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)

    def raster(self, mask_key: str, height: int, width: int) -> np.ndarray:
        """A mask's pixels."""
        runs = (self.sidewalks | self.obstacles)[mask_key]
        flips = np.zeros((height, width + 1), np.int32)
        np.add.at(flips, (runs[:, 0], np.maximum(runs[:, 1], 0)), 1)
        np.add.at(flips, (runs[:, 0], np.minimum(runs[:, 2] + 1, width)), -1)
        return np.cumsum(flips, axis=1)[:, :-1] > 0


FIELDS = ("image_blob", "masks_prefix", "metadata")


def _described(images: DataFrame, key: str) -> list[Column]:
    kinds = dict(images.dtypes)
    about = F.lit("{}")
    if "metadata" in kinds:
        about = F.coalesce(F.col("metadata") if kinds["metadata"] == "string" else F.to_json("metadata"), F.lit("{}"))
    texts = [(F.col(c) if c in kinds else F.lit(None)).cast("string").alias(c) for c in FIELDS[:2]]
    return [F.col(key), *texts, about.alias("metadata")]


def _split_masks(runs: pa.Table) -> tuple[dict, dict]:
    """Runs by mask, apart by whether the class is a sidewalk."""
    parts: tuple[dict, dict] = ({}, {})
    runs = runs.sort_by([("mask_key", "ascending"), ("r", "ascending"), ("c0", "ascending")])
    names, classes = runs["mask_key"].to_pylist(), runs["class_name"].to_pylist()
    cells = np.stack([runs[c].to_numpy() for c in ("r", "c0", "c1")], axis=1) if names else np.empty((0, 3), int)
    starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
    for i, j in pairwise([*starts, len(names)]):
        parts["sidewalk" not in (classes[i] or "").lower()][names[i]] = cells[i:j]
    return parts


def junction_analyzer(images: DataFrame, mask_runs: DataFrame | None = None, fn: Callable[[JunctionImage], Any] | None = None, key: str = "image_id") -> DataFrame:
    """One row an image: key, status, image_blob, masks_prefix, metadata and analysis (JSON), error.

    images: key and, where there are, image_blob, masks_prefix, metadata (JSON, struct or map) and content. mask_runs: key,
    mask_key, class_name, r, c0, c1. Without ``fn`` each image is a junction_stub. With it, images and runs are cogrouped, so that an image
    without masks is analyzed too and masks without an image are not; what ``fn`` returns becomes ``analysis`` and the status
    junction_analyzed. If it raises, that image alone has the status E: and the exception's name, with the message as its error."""
    described = _described(images, key)
    kind = images.schema[key].dataType.simpleString()
    if fn is None:
        return images.select(F.col(key), F.lit("junction_stub").alias("status"), *described[1:], F.lit(None).cast("string").alias("analysis"), F.lit(None).cast("string").alias("error"))
    if mask_runs is None:
        raise ValueError("an analyzer needs mask_runs")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        masks = _split_masks(right) if rows else ({}, {})
        out: dict[str, list] = {n: [] for n in (key, "status", *FIELDS, "analysis", "error")}
        for row in rows:
            status, analysis, error = "junction_analyzed", None, None
            try:
                found = fn(JunctionImage(row[key], row["content"], *masks, json.loads(row["metadata"])))
                analysis = json.dumps(found, default=str)
            except Exception as e:  # the caller's own function: any failure is that image's result
                status, error = f"E:{type(e).__name__}", str(e)
            for n, v in {**{n: row[n] for n in (key, *FIELDS)}, "status": status, "analysis": analysis, "error": error}.items():
                out[n].append(v)
        return pa.table({n: pa.array(v, left.schema.field(key).type if n == key else pa.string()) for n, v in out.items()})

    content = F.col("content") if "content" in images.columns else F.lit(None).cast("binary")
    left = images.select(*described, content.alias("content")).groupBy(key)
    right = mask_runs.select(key, F.col("mask_key").cast("string"), F.col("class_name").cast("string"), *[F.col(c).cast("int") for c in ("r", "c0", "c1")]).groupBy(key)
    fields = ", ".join(f"{n} string" for n in ("status", *FIELDS, "analysis", "error"))
    return left.cogroup(right).applyInArrow(run, f"`{key}` {kind}, {fields}")


def junction_documents(analyzed: DataFrame, key: str = "image_id") -> DataFrame:
    """key and the JSON document of each row: status, image_blob, masks_prefix, metadata, analysis."""
    body = F.struct("status", "image_blob", "masks_prefix", F.parse_json("metadata").alias("metadata"), F.parse_json("analysis").alias("analysis"))
    return analyzed.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))
