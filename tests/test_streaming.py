"""Streams over files: order of arrival, restarts and incremental re-projection."""

import os
import random

from pyspark.sql import functions as F

from slotvalue.operators import links, resolve
from slotvalue.schema import LINK_EVENT
from slotvalue.sources import writers
from slotvalue.streaming import jobs
from tests.test_identity import BOX, DETECTION, catalog

EVENT = "seq bigint, ts string, icon_id string, item_id string"


def log(spark, path, *rows):
    writers.append_log(writers.manual_events(spark.createDataFrame(rows, EVENT)).coalesce(1), path)


def test_links_survive_restart_and_late_events(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("log", "links", "state"))
    log(spark, path, (5, "t", "1", "new"), (2, "t", "2", "x"))
    jobs.maintain_links(jobs.stream_events(spark, path), out, state).awaitTermination()
    log(spark, path, (3, "t", "1", "late"), (6, "t", "2", "y"))
    jobs.maintain_links(jobs.stream_events(spark, path), out, state).awaitTermination()
    assert {r.icon_id: r.item_id for r in jobs.current_links(spark, out).collect()} == {"1": "new", "2": "y"}
    assert {r.icon_id for r in jobs.changes_since(spark, out, 0).collect()} == {"1", "2"}
    assert jobs.changes_since(spark, out, 1).isEmpty()


def test_many_small_batches_equal_one(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("log", "links", "state"))
    for n in range(4):
        log(spark, path, (n, "t", str(n % 2), f"item{n}"))
    jobs.maintain_links(jobs.stream_events(spark, path, files_per_batch=1), out, state).awaitTermination()
    assert {r.icon_id: r.item_id for r in jobs.current_links(spark, out).collect()} == {"0": "item2", "1": "item3"}
    assert len([d for d in os.listdir(out + "/writer=main") if d.startswith("version=")]) >= 4


def layered(spark):
    auto = spark.createDataFrame([("2", "a", 12.0, 5.0)], "icon_id string, item_id string, score double, margin double")
    flat = spark.createDataFrame([], "icon_id string, item_id string")
    return lambda manual: links.project_links(auto, flat, manual.withColumn("source", F.lit("manual")))


def none(spark):
    return spark.createDataFrame([], "icon_id string, item_id string, seq bigint")


def seen(spark, out):
    return {(r.session_id, r.det_idx): (r.id, r.source, r.writer) for r in jobs.current_records(spark, out).collect()}


def test_reprojection_touches_only_affected_sessions(spark, tmp_path):
    rows = [("s1", 0, "1", BOX, 0.9, "", 0.0, ""), ("s1", 1, "2", BOX, 0.9, "", 0.0, ""), ("s2", 0, "2", BOX, 0.9, "", 0.0, "")]
    path, store, links_out, out, state = (str(tmp_path / n) for n in ("log", "store", "links", "records", "state"))
    stored = spark.createDataFrame(rows, DETECTION)
    jobs.store_detections(stored, store, 4)
    jobs.write_records(resolve.resolve(stored, layered(spark)(none(spark)), catalog(spark)), out, 0, "scan", 4)
    log(spark, path, (1, "t", "1", "b"))
    jobs.maintain_records(
        jobs.stream_events(spark, path), store, layered(spark), lambda: catalog(spark), links_out, out, state, buckets=4
    ).awaitTermination()
    assert seen(spark, out) == {
        ("s1", 0): ("b", "override", "correction"), ("s1", 1): ("a", "yolo", "correction"), ("s2", 0): ("a", "yolo", "scan"),
    }


def scan(spark, path, out, state, **more):
    links_now = more.pop("links_of", lambda: layered(spark)(none(spark)))
    jobs.value_detections(
        jobs.stream_detections(spark, path, files_per_batch=1), links_now, lambda: catalog(spark), out, state, buckets=4, **more
    ).awaitTermination()


def test_a_session_in_several_batches_is_whole(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("scans", "records", "state"))
    rows = spark.createDataFrame([("s1", n, "2", BOX, 0.9, "", 0.0, "") for n in range(10)], DETECTION)
    rows.where("det_idx < 6").repartition(3, "det_idx").write.parquet(path)
    scan(spark, path, out, state)
    rows.where("det_idx >= 6").repartition(2, "det_idx").write.mode("append").parquet(path)
    scan(spark, path, out, state)
    assert sorted(n for _, n in seen(spark, out)) == list(range(10))


def test_a_later_scan_keeps_corrections(spark, tmp_path):
    path, events, store, links_out, out = (str(tmp_path / n) for n in ("scans", "log", "store", "links", "records"))
    states = [str(tmp_path / n) for n in ("scanned", "corrected")]

    def links_now():
        return layered(spark)(jobs.current_links(spark, links_out))

    spark.createDataFrame([("s1", 0, "1", BOX, 0.9, "", 0.0, "")], DETECTION).coalesce(1).write.parquet(path)
    scan(spark, path, out, states[0], store=store, links_of=links_now)
    log(spark, events, (1, "t", "1", "b"))
    jobs.maintain_records(
        jobs.stream_events(spark, events), store, layered(spark), lambda: catalog(spark), links_out, out, states[1], buckets=4
    ).awaitTermination()
    more = [("s2", 0, "2", BOX, 0.9, "", 0.0, ""), ("s1", 1, "1", BOX, 0.9, "", 0.0, "")]
    spark.createDataFrame(more, DETECTION).coalesce(1).write.mode("append").parquet(path)
    scan(spark, path, out, states[0], store=store, links_of=links_now)
    assert seen(spark, out) == {
        ("s1", 0): ("b", "override", "correction"), ("s1", 1): ("b", "override", "scan"), ("s2", 0): ("a", "yolo", "scan"),
    }


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    out, store = str(tmp_path / "records"), str(tmp_path / "store")
    rows = spark.createDataFrame([("s1", n, "2", BOX, 0.9, "", 0.0, "") for n in range(3)], DETECTION)
    for _ in range(2):
        jobs.store_detections(rows, store, 4, version=7, writer="scan")
        jobs.write_records(resolve.resolve(rows, layered(spark)(none(spark)), catalog(spark)), out, 7, "scan", 4)
    assert jobs.current_records(spark, out).count() == jobs.stored_detections(spark, store).count() == 3


def test_stored_index_gives_the_same_sessions(spark, tmp_path):
    rows = [(f"s{n % 7}", n, str(n % 11), BOX, 0.9, "", 0.0, "") for n in range(60)]
    given = spark.createDataFrame(rows, DETECTION)
    jobs.store_detections(given, str(tmp_path), buckets=4)
    icons = spark.createDataFrame([("3",), ("5",), ("99",)], "icon_id string")
    stored, index = jobs.stored_detections(spark, str(tmp_path)), jobs.stored_index(spark, str(tmp_path))
    expected = sorted(jobs.affected_sessions(given, icons).collect())
    assert sorted(jobs.affected_sessions(index, icons, buckets=4).collect()) == expected
    assert sorted(stored.select(*given.columns).collect()) == sorted(given.collect())
    scan = jobs.affected_sessions(index, icons, buckets=4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(icon_bucket" in scan or "PartitionFilters: [icon_bucket" in scan


def test_one_session_reads_its_bucket_only(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{n}", 0, "2", BOX, 0.9, "", 0.0, "") for n in range(20)], DETECTION)
    jobs.write_records(resolve.resolve(rows, layered(spark)(none(spark)), catalog(spark)), str(tmp_path), 0, "scan", 8)
    found = jobs.sessions(spark, str(tmp_path), ["s3"], 8)
    assert [r.session_id for r in found.collect()] == ["s3"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "session_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_compaction_keeps_the_newest_rows(spark, tmp_path):
    out, target = str(tmp_path / "out"), str(tmp_path / "target")
    schema = "session_id string, det_idx bigint, v int"
    jobs.write_records(spark.createDataFrame([("s1", 0, 1), ("s2", 0, 1)], schema), out, 0, "scan", 4)
    jobs.write_records(spark.createDataFrame([("s1", 0, 2)], schema), out, 3, "correction", 4)
    jobs.compact_records(spark, out, target, 4)
    assert sorted((r.session_id, r.v, r.version) for r in jobs.current_records(spark, target).collect()) == [("s1", 2, 0), ("s2", 1, 0)]


def test_link_compaction(spark, tmp_path):
    out, target = str(tmp_path / "out"), str(tmp_path / "target")
    schema = "icon_id string, item_id string, seq bigint"
    jobs.write_version(spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], schema), out, 0)
    jobs.write_version(spark.createDataFrame([("1", "c", 3)], schema), out, 1)
    jobs.compact_links(spark, out, target)
    assert sorted(jobs.current_links(spark, target).collect()) == [("1", "c", 3), ("2", "b", 2)]


def test_refresh_reaches_links_and_texts(spark, tmp_path):
    after = catalog(spark)
    before = after.withColumn("avg24h", F.when(F.col("item_id") == "a", 101).otherwise(F.col("avg24h")).cast("bigint"))
    assert [r.item_id for r in jobs.repriced_items(before, after).collect()] == ["a"]
    assert [r.item_id for r in jobs.repriced_items(before, before, "avg24h", "low").collect()] == ["a"]
    rows = [
        ("text", 0, "1", BOX, 0.9, "a", 0.3, ""), ("link", 0, "2", BOX, 0.9, "", 0.0, ""), ("other", 0, "1", BOX, 0.9, "b", 0.3, ""),
    ]
    store, out = str(tmp_path / "store"), str(tmp_path / "records")
    stored = spark.createDataFrame(rows, DETECTION)
    shown = layered(spark)(none(spark))
    jobs.store_detections(stored, store, 4)
    jobs.write_records(resolve.resolve(stored, shown, before), out, 0, "scan", 4)
    jobs.refresh_records(spark, store, shown, before, after, out, 0, buckets=4)
    got = {r.session_id: (r.id, r.value, r.writer) for r in jobs.current_records(spark, out).collect()}
    want = {r.session_id: (r.id, r.value) for r in resolve.resolve(stored, shown, after).collect()}
    assert {s: v[:2] for s, v in got.items()} == want
    assert {s: v[2] for s, v in got.items()} == {"text": "refresh", "link": "refresh", "other": "scan"}


def test_refresh_only_when_stale(spark):
    def age(hours):
        return spark.range(1).select(F.lit(hours).cast("double").alias("age_h"))

    def load():
        return spark.range(2)

    assert jobs.refresh_catalog(age(23.9), load, lambda df: writers.write_snapshot(df, "c")) is None
    assert jobs.refresh_catalog(age(24.0), load, lambda df: writers.write_snapshot(df, "c"))
    assert jobs.refresh_catalog(age(None), load, lambda df: writers.write_snapshot(df, "c"))


def log_in_parts(spark, tmp_path, parts, **more):
    """Links and state after each part of a log, every part met by a stream that starts anew."""
    log, out, state = (str(tmp_path / n) for n in ("log", "links", "state"))
    for part in parts:
        rows = [(s, "t", i, x, "manual", 100, "") for s, i, x in part]
        spark.createDataFrame(rows, LINK_EVENT).coalesce(1).write.mode("append").json(log)
        jobs.maintain_links(jobs.stream_events(spark, log), out, state, **more).awaitTermination()
    return out, state


def links_of(df):
    return {r.icon_id: (r.item_id, r.seq) for r in df.collect()}


def test_links_come_from_the_state(spark, tmp_path):
    parts = [[(1, "a", "x"), (5, "b", "late")], [(3, "a", "y"), (2, "b", "early")], [(4, "c", "z")]]
    out, state = log_in_parts(spark, tmp_path, parts)
    assert links_of(jobs.links_in_state(spark, state)) == {"a": ("y", 3), "b": ("late", 5), "c": ("z", 4)}
    assert links_of(jobs.links_in_state(spark, state, 0)) == {"a": ("x", 1), "b": ("late", 5)}
    assert links_of(jobs.links_in_state(spark, state, -1)) == links_of(jobs.links_in_state(spark, str(tmp_path / "none"))) == {}
    changed = spark.createDataFrame([("a", "w", 9), ("b", "old", 1)], jobs.LINKS)
    assert links_of(jobs.links_as_of(spark, state, 1, changed)) == {"a": ("w", 9), "b": ("late", 5)}
    # The state is read, not the versions.
    plan = jobs.links_in_state(spark, state)._jdf.queryExecution().toString()
    assert out not in plan and links_of(jobs.links_in_state(spark, state)) == links_of(jobs.current_links(spark, out))


def test_a_stream_folds_its_versions(spark, tmp_path):
    rng = random.Random(3)
    parts = [[(10 * p + n, f"i{rng.randrange(6)}", f"v{p}{n}") for n in range(4)] for p in range(7)]
    out, state = log_in_parts(spark, tmp_path, parts, compact_every=2)
    want = {}
    for part in parts:
        for seq, icon, item in part:
            want[icon] = (item, seq)
    assert links_of(jobs.current_links(spark, out)) == links_of(jobs.links_in_state(spark, state)) == want
    main, fold = jobs._versions(spark, out, "main"), jobs._versions(spark, out, "fold")
    # Folds at 1, 3 and 5: those before the last but one, and the versions they hold, are gone.
    assert sorted(main) == [4, 5, 6] and sorted(fold) == [3, 5]
    for seen in range(-1, 6):
        known = {}
        for part in parts[: seen + 1]:
            known |= {icon: (item, seq) for seq, icon, item in part}
        for r in jobs.changes_since(spark, out, seen).collect():
            if r.seq >= known.get(r.icon_id, ("", -1))[1]:
                known[r.icon_id] = (r.item_id, r.seq)
        assert known == want


def test_a_repeated_fold_changes_nothing(spark, tmp_path):
    out, state = log_in_parts(spark, tmp_path, [[(1, "a", "x")], [(2, "b", "y")]], compact_every=2)
    before = links_of(jobs.current_links(spark, out))
    jobs.fold_links(spark, out, jobs.links_in_state(spark, state), 1)
    assert links_of(jobs.current_links(spark, out)) == before and sorted(jobs._versions(spark, out, "fold")) == [1]


def test_few_folders_are_written_without_a_shuffle(spark, tmp_path):
    rows = spark.range(600).select(F.format_string("s%d", F.col("id") % 50).alias("session_id"), F.col("id").alias("det_idx")).repartition(3)
    for buckets, files in ((4, 3), (jobs.BUCKETS, 1)):
        out = str(tmp_path / str(buckets))
        jobs.write_records(rows, out, 0, "main", buckets)
        found = jobs.current_records(spark, out)
        assert sorted(r.det_idx for r in found.collect()) == list(range(600))
        folders = [os.path.join(jobs.version_path(out, "main", 0), d) for d in os.listdir(jobs.version_path(out, "main", 0)) if d.startswith("session")]
        assert {len([f for f in os.listdir(d) if f.endswith(".parquet")]) for d in folders} == {files}
