"""Reports in several batches, compacted, with a run that dies on the way; and folders of segment documents."""

from __future__ import annotations

import glob
import json

from pyspark.sql import functions as F

from curbline.sources import writers
from curbline.streaming import reports


def test_compaction_keeps_each_report_once(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    sent = 0
    for batch in range(4):
        rows = [{"pointId": f"0{i % 3}", "direction": "left", "description": f"hole {batch} {i}", "timestamp": "2024-01-02T03:04:05Z"} for i in range(7)]
        (src / f"{batch}.json").write_text("\n".join(map(json.dumps, rows)))
        sent += len(rows)
        reports.stream_reports(spark, str(src), out, str(tmp_path / "ck")).awaitTermination()

    def seen() -> list[str]:
        return sorted(r.description for r in reports.read_reports(spark, out).collect())

    wanted = seen()
    assert len(wanted) == sent == len(set(wanted))
    assert {r.point_id for r in reports.read_reports(spark, out).collect()} == {"00", "01", "02"}
    for batch in range(4):
        assert len(glob.glob(f"{out}/reports/batch={batch}/point_id=00/direction=left/*.json")) == 1

    def dies(*_):
        raise OSError("gone")

    monkeypatch.setattr(reports, "delete", dies)
    try:
        reports.compact_reports(spark, out)
    except OSError:
        pass
    assert seen() == wanted  # compacted, and the batches are still there
    monkeypatch.undo()
    assert reports.compact_reports(spark, out) is None and seen() == wanted
    assert len(glob.glob(f"{out}/reports/batch=*")) == 1 and len(glob.glob(f"{out}/compacted/*/point_id=00/direction=left/*.json")) == 1
    assert reports.compact_reports(spark, out, keep_batches=0) == 3 and seen() == wanted
    assert not glob.glob(f"{out}/reports/batch=*") and len(glob.glob(f"{out}/compacted/upto=*")) == 1
    assert reports.read_reports(spark, str(tmp_path / "none")).count() == 0


def test_buckets_hold_many_points_in_few_files(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    ways = ("left", "right", "forward", "a b/c")
    for batch in range(2):
        rows = [{"pointId": f"0{i}", "direction": ways[i % 4], "description": f" hole {batch} {i} ", "timestamp": "2024-01-02T03:04:05Z"} for i in range(200)] + [{"pointId": "x", "direction": "left", "description": " "}]
        (src / f"{batch}.json").write_text("\n".join(map(json.dumps, rows)))
        reports.stream_reports(spark, str(src), out, str(tmp_path / "ck"), buckets=None if batch else 8).awaitTermination()
    assert len(glob.glob(f"{out}/reports/batch=0/bucket=*/*.json")) <= 8

    def seen() -> list[tuple]:
        return sorted((r.point_id, r.direction, r.description, r.key) for r in reports.read_reports(spark, out).collect())

    wanted = sorted((f"0{i}", ways[i % 4], f"hole {batch} {i}", f"reports/0{i}/{ways[i % 4]}/2024-01-02T03-04-05-000Z.json") for batch in range(2) for i in range(200))
    assert seen() == wanted  # a batch of either layout
    assert reports.compact_reports(spark, out, keep_batches=0, buckets=8) == 1 and seen() == wanted
    assert len(glob.glob(f"{out}/compacted/upto=1/bucket=*/*.json")) <= 8 and not glob.glob(f"{out}/reports/batch=*")
    assert reports.read_reports(spark, out).columns == spark.createDataFrame([], reports.STORED_REPORT).columns


def test_a_file_a_folder_of_segment_documents(spark, tmp_path):
    rows = spark.range(600).repartition(8).select((F.col("id") % 5).cast("string").alias("coordinate_folder"), F.lit("left").alias("direction"), (F.col("id") % 2).cast("string").alias("segment"), "id")
    writers.sink_segment_documents(rows, str(tmp_path / "docs"))
    files = glob.glob(f"{tmp_path}/docs/*/*/*/*.json")
    assert len(files) == len({f.rsplit("/", 1)[0] for f in files}) == 10
    assert spark.read.json(str(tmp_path / "docs")).count() == 600
