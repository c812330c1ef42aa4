"""Scans and sinks on small hand-written files."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from slotvalue.operators import dataset, manifest, reports, spatial
from slotvalue.sources import readers, writers


def put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    mode = "wb" if isinstance(content, bytes) else "w"
    with open(path, mode) as f:
        f.write(content)


def test_catalog_last_duplicate_wins(spark, tmp_path):
    items = [
        {"id": "a", "name": "old", "shortName": None, "width": 1, "sellFor": None},
        {"id": "b", "name": "other", "shortName": "O", "sellFor": [{"priceRUB": 7, "vendor": {"name": "V"}}, {"priceRUB": None}]},
        {"id": "a", "name": "new", "shortName": "N", "avg24hPrice": 5, "sellFor": []},
    ]
    put(str(tmp_path / "items.json"), json.dumps(items))
    read = readers.read_catalog_arrays(spark, str(tmp_path / "items.json"))
    got = {r.item_id: r for r in readers.flat_catalog(readers.latest_items(read, "file", "pos")).collect()}
    assert (got["a"].name, got["a"].short, got["a"].avg24h, got["a"].vendor) == ("new", "N", 5, 0)
    assert got["b"].vendor == 7


def test_missing_files_are_empty_tables(spark, tmp_path):
    nowhere = str(tmp_path / "none.json")
    for read in (readers.read_catalog_arrays, readers.read_catalog_lines, readers.read_auto_links, readers.read_overrides, readers.read_link_events, readers.read_plain_log, readers.read_files):
        assert read(spark, nowhere).isEmpty()
    assert readers.snapshot_age(spark, nowhere, "2024-01-01 00:00:00").select(readers.stale(F.col("age_h"))).first()[0] is True


def test_json_maps(spark, tmp_path):
    put(str(tmp_path / "auto.json"), json.dumps({"1": {"item_id": "a", "score": 3, "margin": None, "alts": ["x"]}, "2": {"match": None, "fp": [1, 2]}}))
    put(str(tmp_path / "flat.json"), json.dumps({"1": "b"}))
    put(str(tmp_path / "empty.json"), "{}")
    auto = {r.icon_id: (r.item_id, r.score, r.alts, r.fp) for r in readers.read_auto_links(spark, str(tmp_path / "auto.json")).collect()}
    assert auto == {"1": ("a", 3.0, ["x"], None), "2": (None, None, None, [1, 2])}
    assert [tuple(r) for r in readers.read_overrides(spark, str(tmp_path / "flat.json")).collect()] == [("1", "b")]
    assert readers.read_overrides(spark, str(tmp_path / "empty.json")).isEmpty()


LOG = """{"ts": "2026-01-01T00:00:09", "icon_id": 2, "item_id": "old", "source": "manual"}

not json
[1, 2]
{"ts": "2026-01-01T00:00:01", "icon_id": "2", "item_id": "new", "source": "manual"}
"""


def test_plain_log_is_ordered_by_line(spark, tmp_path):
    put(str(tmp_path / "log.jsonl"), LOG)
    rows = sorted((r.seq, r.icon_id, r.item_id) for r in readers.read_plain_log(spark, str(tmp_path / "log.jsonl")).collect())
    assert rows == [(0, "2", "old"), (4, "2", "new")]


def test_appended_log_keeps_rejects(spark, tmp_path):
    path = str(tmp_path / "log")
    fixes = spark.createDataFrame([(1, "t", 5, "a")], "seq bigint, ts string, icon_id int, item_id string")
    writers.append_log(writers.manual_events(fixes), path)
    writers.append_log(writers.manual_events(fixes.withColumn("seq", F.lit(2).cast("bigint"))), path)
    put(os.path.join(path, "hand.json"), "\nbroken\n")
    events = readers.read_link_events(spark, path)
    assert sorted((r.source, r.lines) for r in readers.log_report(events).collect()) == [("manual", 2), ("rejected", 1)]
    assert sorted((r.seq, r.icon_id, r.certainty, r.note) for r in readers.clean_events(events).collect()) == [(1, "5", 100, ""), (2, "5", 100, "")]


def png(width, height):
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + width.to_bytes(4, "big") + height.to_bytes(4, "big") + b"\x08\x06\x00\x00\x00"


def test_icons(spark, tmp_path):
    put(str(tmp_path / "12.png"), png(64, 127))
    put(str(tmp_path / "x1.png"), png(64, 64))
    put(str(tmp_path / "13.webp"), b"abc")
    rows = [tuple(r) for r in readers.read_icons(spark, str(tmp_path)).collect()]
    assert rows == [(12, 64, 127, hashlib.sha256(png(64, 127)).hexdigest(), 29, 1, 2)]
    digests = {r.file: r.sha256 for r in readers.file_digests(spark, str(tmp_path)).collect()}
    assert digests["13.webp"] == hashlib.sha256(b"abc").hexdigest() and len(digests) == 3


def test_worklist_skips_full_files(spark, tmp_path):
    put(str(tmp_path / "a.webp"), b"x")
    put(str(tmp_path / "b.webp"), b"")
    items = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "u"), ("d", None), ("e", "")], "item_id string, link string")
    todo = manifest.worklist(items, readers.read_files(spark, str(tmp_path)))
    assert sorted(r.item_id for r in todo.collect()) == ["b", "c"]


def test_sessions_by_folder(spark, tmp_path):
    for session, total in (("20260101-000001", 5), ("20260102-000001", 7)):
        put(str(tmp_path / session / "scan.json"), json.dumps({"total": total}))
    put(str(tmp_path / "20260103-000001" / "raw.txt"), "no result")
    stored = readers.read_sessions(spark, str(tmp_path), "total bigint")
    assert [r.session_id for r in readers.list_sessions(stored).collect()] == ["20260102-000001", "20260101-000001"]
    assert readers.replay(stored, "20260101-000001").first().total == 5


def test_grids_and_cells(spark, tmp_path):
    put(str(tmp_path / "grids.json"), json.dumps([{"name": "g", "x": 1, "y": 2, "w": 100, "h": 50, "cols": 4, "rows": 2}, {"name": "h", "x": 0, "y": 0, "w": 9, "h": 9}]))
    grids = readers.read_grids(spark, str(tmp_path / "grids.json"))
    assert sorted((r.name, r.cols, r.cw, r.ch) for r in grids.collect()) == [("g", 4, 25.0, 25.0), ("h", 1, 9.0, 9.0)]
    assert spatial.placements(grids, 2, 2).count() == 3
    assert spatial.placements(grids, 1, 1).count() == 9


def test_metrics(spark, tmp_path):
    head = ",".join(readers.METRICS.fieldNames())
    for model, best in (("m-v1", 2), ("m-v2", 3)):
        lines = [",".join(["%d" % e, "%.1f" % (e * 10)] + ["0.5"] * 5 + ["0.9" if e == best else "0.1"] + ["0.5"] * 7) for e in (1, 2, 3)]
        put(str(tmp_path / model / "results.csv"), "\n".join([head, *lines]))
    got = {r.model: (r.best_epoch, r.best_quality, r.last_epoch, r.seconds) for r in reports.run_summary(readers.read_metrics(spark, str(tmp_path) + "/*/results.csv")).collect()}
    assert got == {"m-v1": (2, 0.9, 3, 30.0), "m-v2": (3, 0.9, 3, 30.0)}


def test_snapshot_age_and_versions(spark):
    path = writers.write_snapshot(spark.range(3).coalesce(1), "items")
    again = writers.write_snapshot(spark.range(3).coalesce(1), "items")
    assert path != again
    later = readers.snapshot_age(spark, path, "2099-01-01 00:00:00").select(readers.stale(F.col("age_h"))).first()[0]
    sooner = readers.snapshot_age(spark, path, "2001-01-01 00:00:00").select(readers.stale(F.col("age_h"))).first()[0]
    assert (later, sooner) == (True, False)


def test_label_files(spark, tmp_path):
    rows = spark.createDataFrame([("train", "s1", 3, 0.8203125, 0.5, 0.1, 0.2)], "split string, scene string, class_idx int, cx double, cy double, w double, h double")
    writers.write_labels(rows, str(tmp_path / "labels"))
    folder = tmp_path / "labels" / "split=train"
    text = "".join(p.read_text() for p in folder.iterdir() if p.suffix == ".txt")
    assert text == "s1\t3 0.820312 0.500000 0.100000 0.200000\n"
    back = writers.read_labels(spark, str(tmp_path / "labels"), "string").first()
    assert (back.split, back.scene, back.value) == ("train", "s1", "3 0.820312 0.500000 0.100000 0.200000")


def test_fingerprints(spark):
    rows = [("m", str(i), hashlib.sha256(str(i).encode()).hexdigest()) for i in range(300)]
    df = spark.createDataFrame(rows, "model string, icon_id string, sha256 string")
    flat = manifest.small_set_fingerprint(df, ["model"]).first()
    lines = sorted(f"{i}:{d}" for _, i, d in rows)
    assert (flat.fingerprint, flat.icons) == (hashlib.sha256("\n".join(lines).encode()).hexdigest(), 300)
    tree = manifest.set_fingerprint(df, 2).first()
    assert tree == manifest.set_fingerprint(df.repartition(7), 2).first()
    changed = df.withColumn("sha256", F.when(F.col("icon_id") == "77", "0").otherwise(F.col("sha256")))
    assert manifest.set_fingerprint(changed, 2).first().fingerprint != tree.fingerprint


def test_drift(spark):
    old = [(1, "a", [0]), (2, "b", [0]), (3, "c", [0]), (4, "d", [0]), (5, "e", [0])]
    new = [(1, "a", [0]), (2, "b2", [3]), (3, "c2", [255]), (14, "d", [0]), (15, "d", [0]), (6, "f", [0])]
    kind = "icon_id bigint, sha256 string, sig array<bigint>"
    got = {r.icon_id: (r.status, r.new_id) for r in manifest.drift(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)).collect()}
    assert got == {
        1: ("unchanged", None), 2: ("cosmetic", None), 3: ("changed", None), 4: ("rekeyed", 14), 5: ("removed", None),
        6: ("new", None), 14: ("new", None), 15: ("new", None),
    }


def test_chunks_are_contiguous_and_even(spark):
    queue = dataset.shuffled(spark.range(10), 1, "id", total="total")
    sizes = [r[1] for r in sorted(dataset.chunked(queue, 4).groupBy("chunk").count().collect())]
    assert sizes == [3, 3, 3, 1]
    assert sorted(r.position for r in queue.collect()) == list(range(10))


def test_small_class_sample_is_repeatable(spark):
    a = dataset.sample_first(spark.range(100), 3, 10, "id").collect()
    b = dataset.sample_first(spark.range(100).repartition(7), 3, 10, "id").collect()
    assert sorted(a) == sorted(b) and len(a) == 10
