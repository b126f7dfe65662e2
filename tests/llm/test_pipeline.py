"""The pipeline's stages on odd rows, and whole against its operators."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline as cp

from .test_operators import SCHEMA, rows


def test_stages(spark, tmp_path):
    spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(30)] + [(None, 1), (2, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows(), SCHEMA)
    columns = docs.columns
    for (name, stage), last in zip(cp.STAGES, [False] * 4 + [True], strict=True):
        docs.write.parquet(str(tmp_path / name))
        docs = stage(spark, spark.read.parquet(str(tmp_path / name)), str(tmp_path))
        if not last:
            assert docs.columns == columns
    assert docs.where(~F.col("round_trip")).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_each_planted_text_survives_once(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    without_id, under_one_id, original, unique, no_ids, near = (" ".join(words[i * 60 : i * 60 + 60]) for i in range(6))
    planted = [(None, without_id), (1, without_id), (2, under_one_id), (2, under_one_id), (3, original), (4, unique), (4, original), (None, no_ids), (None, no_ids), (5, near), (5, near.replace("w359", "other")), (6, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(*x, *rows()[0][2:]) for x in planted], SCHEMA)
    stages = dict(cp.STAGES)
    docs = stages["near_duplicates"](spark, docs, str(tmp_path))
    for texts in (docs, stages["substring_dedup"](spark, docs, str(tmp_path))):
        got = [(r.doc_id, r.text or "") for r in texts.select("doc_id", "text").collect()]
        assert [t for _, t in got].count("") == 3
        full = sorted((i or 0, t.replace("other", "w359")) for i, t in got if t)
        assert full == sorted([(1, without_id), (2, under_one_id), (3, original), (4, unique), (0, no_ids), (5, near)])


def test_run_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    out = cp.run(spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0 < out.count() <= 3 * n and out.where(~F.col("round_trip")).count() == 0
