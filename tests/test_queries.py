"""Every query with SQL against DuckDB on the smallest tables; of the others some rows are collected, but for slow ones."""

from __future__ import annotations

import glob
import inspect
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from curbline.operators import cloud
from curbline.plans import registry

SF = "/root/testdata/sf0.001"
SLOW = {"measure_width_points", "alt_width_batch", "sample_polygon", "footprint_metadata"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def value(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return int(v) if float(v).is_integer() else round(float(v), 6)
    return v


def norm(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr([value(v) for v in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_duckdb(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert norm(ours) == norm(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - SLOW))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).limit(5).collect()


@pytest.mark.parametrize("name, operator", [("fit_ground_plane", "fit_ground_plane"), ("measure_width_points", "measure_width_points"), ("alt_width_batch", "measure_width_points")])
def test_plane_queries_try_all_hypotheses(spark, monkeypatch, name, operator):
    class Seen(Exception):
        pass

    signature = inspect.signature(getattr(cloud, operator))

    def spy(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        raise Seen(bound.arguments["iters"])

    monkeypatch.setattr(cloud, operator, spy)
    with pytest.raises(Seen) as seen:
        registry.QUERIES[name](spark, SF)
    assert seen.value.args == (1000,)


def test_a_path_missing_twice_has_two_rows(spark):
    from curbline.operators import resolve

    missing = spark.createDataFrame([("r/p/20240101T000000Z/a.jpg",)] * 2 + [("r/p/20240101T000000Z/b.jpg",)], "path string")
    there = spark.createDataFrame([("r/p/20240101T000000Z_re/a.jpg",), ("r/p/20240101T000000Z_rerun/a.jpg",), ("r/p/20240101T000000Z_rerun/a.jpg",)], "path string")
    got = sorted(map(tuple, resolve.resolve_run_alias(missing, there).collect()))
    assert got == [("r/p/20240101T000000Z/a.jpg", "r/p/20240101T000000Z_rerun/a.jpg")] * 2


def test_documents_are_written_where_they_are(spark, tmp_path, monkeypatch):
    """No range partitioning, whose sample of texts would go through the driver; no copy of the lines."""
    import json
    from pathlib import Path

    from curbline.plans import queries_names
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "repartitionByRange", None)
    queries_names.json_documents(spark.range(0, 12_000, 1, 2), str(tmp_path / "docs"))
    read = [json.loads(p.read_text()) for p in Path(tmp_path / "docs").glob("part-*")]
    assert max(map(len, read)) == 5000 and len(read) == 5 and {x["id"] for docs in read for x in docs} == set(range(12_000))
    assert not (tmp_path / "docs-lines").exists()


def test_strict_manifest_is_not_sorted(spark, monkeypatch):
    """All its rows but the header had one place in the order, so a sort brought them into one task."""
    from __spark_entry__ import SMOKE_DIR, queries
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "orderBy", None)
    got = queries()["scan_manifest_strict"](spark, SMOKE_DIR)
    assert got.columns == ["point_id", "point_type", "note"] and got.where("note like '%, ok'").count() == got.count() == 1500 - 30


def test_pixels_of_gradients_come_after_columns(spark):
    from __spark_entry__ import SMOKE_DIR, queries

    plan = queries()["gradient_peak"](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and plan.rindex("Generate") < plan.rindex("HashAggregate")


def test_upright_spans_are_drawn_in_order(spark, tmp_path):
    from curbline.plans import queries_names
    from curbline.sources import readers

    rows = spark.createDataFrame([("a.png", 6, 4, [[1, 0, 3, 1], [1, 2, 5, 2], [3, 1, 1, 1]], "upright")], "path string, h int, w int, spans array<array<int>>, kind string")
    written = queries_names.written_png(rows, f"file://{tmp_path}")
    assert "MapInArrow" in written._jdf.queryExecution().executedPlan().toString() and written.count() == 1
    got = readers.scan_label_runs(spark, f"file://{tmp_path}", {1: "sidewalk", 2: "road"})
    assert sorted(map(tuple, got.select("label", "x", "y0", "y1").collect())) == [("road", 1, 2, 5), ("sidewalk", 1, 0, 1), ("sidewalk", 3, 1, 1)]
