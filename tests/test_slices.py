"""Record stores are written in parts of bounded size, and hold the shuffles of one part at a time."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from slotvalue.operators import resolve
from slotvalue.plans.oracle import ORACLE
from slotvalue.plans.queries import QUERIES
from slotvalue.streaming import jobs
from tests.compare import connect, differences
from tests.test_identity import BOX, DETECTION, catalog
from tests.test_streaming import layered, none

SF = "/root/testdata/sf0.001"


def scanned(spark, n, text="", first=0):
    rows = [(f"s{i % 9}", i, "2", BOX, 0.9, text, 0.95 if text else 0.0, "") for i in range(first, first + n)]
    return spark.createDataFrame(rows, DETECTION)


def writes(monkeypatch):
    """What ``write_records`` is called with: writer and mode."""
    seen, write = [], jobs.write_records

    def noted(records, out, version, writer, buckets=jobs.BUCKETS, commit=None, mode="overwrite"):
        seen.append((writer, mode))
        write(records, out, version, writer, buckets, commit, mode)

    monkeypatch.setattr(jobs, "write_records", noted)
    return seen


def test_a_written_version_leaves_no_shuffles(spark, tmp_path):
    def shuffles():
        return set(glob.glob(os.path.join(spark.conf.get("spark.local.dir"), "**", "shuffle_*.data"), recursive=True))

    before = shuffles()
    rows = resolve.resolve(scanned(spark, 60).repartition(3), layered(spark)(none(spark)), catalog(spark))
    jobs.write_records(rows.repartition(5, "session_id"), str(tmp_path), 0, "scan", 4)
    left = time.time() + 10
    while shuffles() - before and time.time() < left:
        time.sleep(0.1)
    assert not shuffles() - before
    assert jobs.current_records(spark, str(tmp_path)).count() == 60


def test_slices_give_the_same_records(spark, tmp_path, monkeypatch):
    store, out = str(tmp_path / "store"), str(tmp_path / "records")
    rows = scanned(spark, 60)
    jobs.store_detections(rows, store, 8)
    monkeypatch.setattr(jobs, "SLICE_BYTES", 1)
    seen, links = writes(monkeypatch), layered(spark)(none(spark))
    for _ in range(2):  # a version that is written again replaces itself
        jobs.reproject(spark, store, None, links, catalog(spark), out, 0, "first", buckets=8)
    assert seen[: len(seen) // 2] == [("first", "overwrite")] + [("first", "append")] * 7
    assert spark.read.parquet(out).select("commit").distinct().count() == 1 and spark.read.parquet(out).count() == 60
    some = spark.createDataFrame([("s3",), ("s4",), ("absent",)], "session_id string")
    jobs.reproject(spark, store, some, links, catalog(spark), out, 0, "second", buckets=8)
    got = jobs.current_records(spark, out)
    want = resolve.resolve(rows, links, catalog(spark))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert {r.session_id for r in got.where("writer = 'second'").collect()} == {"s3", "s4"}
    nobody = spark.createDataFrame([], "session_id string")
    jobs.reproject(spark, store, nobody, links, catalog(spark), out, 0, "second", buckets=8)
    assert jobs.current_records(spark, out).where("writer = 'second'").isEmpty()


def test_the_newest_stored_copy_is_redone(spark, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "records")
    jobs.store_detections(scanned(spark, 20), store, 4, 5)
    jobs.store_detections(scanned(spark, 10, text="b"), store, 4, 2)  # a later scan, whatever its number
    jobs.reproject(spark, store, None, layered(spark)(none(spark)), catalog(spark), out, 0, "first", buckets=4)
    assert {r.det_idx: r.ocr.id for r in jobs.current_records(spark, out).collect()} == {i: "b" if i < 10 else "" for i in range(20)}
    assert {r.det_idx: r.ocr.id for r in jobs.sessions(spark, out, ["s1"], 4).collect()} == {1: "b", 10: ""} | {19: ""}
    assert "stored" not in jobs.current_records(spark, out).columns


def test_indexes_are_written_by_the_tasks_that_read(spark, tmp_path):
    rows = spark.range(600).select(
        F.format_string("s%d", F.col("id") % 50).alias("session_id"), F.col("id").alias("det_idx"), F.format_string("i%d", F.col("id") % 20).alias("icon_id"),
        F.lit("t").alias("ocr_id"),
    ).repartition(3)
    jobs.store_detections(rows, str(tmp_path), 2)
    folders = glob.glob(str(tmp_path / "icons/writer=main/version=0/icon_bucket=*"))
    assert {len(glob.glob(f + "/*.parquet")) for f in folders} == {3}


def test_texts_are_joined_before_icons(spark):
    records = resolve.resolve(scanned(spark, 3), layered(spark)(none(spark)), catalog(spark))
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    last = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    assert "icon_id" in last and "ocr_id" not in last


def test_arriving_files_are_met_in_batches(spark, tmp_path, monkeypatch):
    path, out, state = (str(tmp_path / n) for n in ("scans", "records", "state"))
    for n in range(3):
        scanned(spark, 7, first=7 * n).coalesce(1).write.mode("append").parquet(path)
    monkeypatch.setattr(jobs, "BATCH_BYTES", 1, raising=False)
    seen, links = writes(monkeypatch), layered(spark)(none(spark))
    jobs.value_detections(jobs.stream_detections(spark, path), lambda: links, lambda: catalog(spark), out, state, buckets=4).awaitTermination()
    assert seen == [("scan", "overwrite")] * 3
    assert {(r.det_idx, r.version) for r in jobs.current_records(spark, out).select("det_idx", "version").collect()} == {(i, i // 7) for i in range(21)}


# Calls of ``write_records`` of each writer, at least, where a batch or slice is one file or bucket.
PARTS = {
    "stream_price_refresh": {"first": 16, "refresh": 2},
    "stream_reprojection": {"first": 16, "correction": 2},
    "stream_scan_and_correct": {"scan": 2, "correction": 2},
}


@pytest.mark.parametrize("name", PARTS)
def test_queries_write_in_parts(spark, monkeypatch, name):
    monkeypatch.setattr(jobs, "SLICE_BYTES", 1)
    monkeypatch.setattr(jobs, "BATCH_BYTES", 1, raising=False)
    seen = writes(monkeypatch)
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == []
    assert {w: n for w, n in PARTS[name].items() if sum(s[0] == w for s in seen) < n} == {}
