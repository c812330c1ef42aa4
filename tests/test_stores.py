"""Binary files, numbered lines and hash trees against plain Python."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from slotvalue.functions import images
from slotvalue.operators import manifest
from slotvalue.sources import files, readers

NAMED = "name string, content binary"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def tree_sha(data, size):
    parts = [data[i : i + size] for i in range(0, max(1, len(data)), size)]
    return sha(data) if len(parts) == 1 else sha("\n".join(map(sha, parts)).encode())


@pytest.mark.parametrize("size", [1, 7, 100, 8 << 20])
def test_files_come_back_in_ranges(spark, tmp_path, size):
    path = str(tmp_path / "store")
    rng = random.Random(size)
    rows = {f"m{i % 3}/f{i}.bin": rng.randbytes(rng.choice([0, 1, 7, 50, 99])) for i in range(12)}
    files.write_files(spark.createDataFrame(list(rows.items()), NAMED).repartition(4), path)
    ranges = files.read_ranges(spark, path, size)
    got = {r.name: (r.length, r.sha256) for r in files.tree_digests(ranges).withColumn("name", files.stored_name()).collect()}
    assert got == {n: (len(c), tree_sha(c, size)) for n, c in rows.items()}
    pieces = {}
    for r in ranges.withColumn("name", files.stored_name()).collect():
        pieces.setdefault(r.name, []).append((r.start, bytes(r.data)))
    assert {n: b"".join(d for _, d in sorted(p)) for n, p in pieces.items()} == rows


def test_further_writes_add_files(spark, tmp_path):
    path = str(tmp_path / "store")
    for n in (b"one", b"two"):
        files.write_files(spark.createDataFrame([("same", n), (n.decode(), n)], NAMED), path)
    names = sorted(r.name for r in files.read_headers(spark, "file:" + path, 2).select(files.stored_name().alias("name")).collect())
    assert names == ["one", "same", "same", "two"]
    with pytest.raises(Exception, match="only added"):
        spark.createDataFrame([("a", b"b")], NAMED).write.format("file_store").mode("overwrite").save(path)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    bad = spark.range(40).select(F.when(F.col("id") == 39, "../escape").otherwise(F.concat(F.lit("f"), F.col("id").cast("string"))).alias("name"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception, match="not a file name"):
        files.write_files(bad.repartition(4), path)
    assert [n for _, _, names in os.walk(path) for n in names] == []
    assert files.read_ranges(spark, path).isEmpty()


def test_headers_do_not_read_the_file(spark, tmp_path):
    large = tmp_path / "7.png"
    with open(large, "wb") as f:
        f.write(images.encode(bytes(64), 16)[:24])
        f.truncate(6 << 30)  # larger than any row; takes no space
    row = readers.read_icons(spark, str(tmp_path), digests=False).first()
    assert (row.icon_id, row.px_w, row.px_h, row.length) == (7, 16, 4, 6 << 30)


def test_hidden_missing_and_unreachable_files(spark, tmp_path):
    (tmp_path / "_staged-x").mkdir()
    for name in ("_staged-x/a", ".hidden", "seen"):
        (tmp_path / name).write_bytes(b"1")
    assert [os.path.basename(r.path) for r in files.read_ranges(spark, str(tmp_path)).collect()] == ["seen"]
    assert files.read_ranges(spark, str(tmp_path / "none")).isEmpty()
    with pytest.raises(Exception, match="cannot be reached"):
        files.read_ranges(spark, "nosuch://store/path").collect()
    assert files.open_store("file:///a/b")[1] == files.open_store("file:/a/b")[1] == files.open_store("/a/b")[1] == "/a/b"
    assert files.store_uri("s3a://bucket/key") == "s3://bucket/key" and files.store_uri("rel/a:b") == "rel/a:b"


def test_pictures_round_trip():
    rng = random.Random(1)
    for width, height in ((1, 1), (8, 8), (64, 1), (300, 300)):
        pixels = rng.randbytes(width * height)
        data = images.encode(pixels, width)
        assert images.decode(data) == pixels and data[16:24] == width.to_bytes(4, "big") + height.to_bytes(4, "big")


def test_line_numbers_over_many_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines[:2500]) + "\n")
    (tmp_path / "b.txt").write_bytes("\r\n".join(lines[2500:]).encode())
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    numbered = readers.numbered_lines(session, str(tmp_path))
    assert session.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    assert sorted(map(tuple, numbered.collect())) == list(enumerate(lines))


def leaf_of(i, depth):
    return hashlib.md5(str(i).encode()).hexdigest()[:depth]


def test_depth_follows_the_number_of_lines(spark):
    assert [manifest.tree_depth(n, 100) for n in (0, 1, 100, 101, 1600, 1601, 25_600, 25_601)] == [0, 0, 0, 1, 1, 2, 2, 3]
    assets = spark.range(6000).select(F.col("id").alias("icon_id"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    depth = manifest.tree_depth(6000, 50)
    largest = manifest._leaves(assets, depth).agg(F.max("icons")).first()[0]
    assert depth == 2 and largest <= 2 * 50
    assert manifest.set_fingerprint(assets).first() == manifest.set_fingerprint(assets, manifest.tree_depth(6000)).first()
    assert manifest.set_fingerprint(assets.limit(0)).collect() == []


def test_trees_differ_where_their_lines_do(spark):
    side = lambda rows: spark.createDataFrame(rows, "icon_id bigint, sha256 string")
    a = [(i, str(i)) for i in range(3000)]
    b = [(i, str(i) if i % 700 else "other") for i in range(3000) if i != 5] + [(9000, "new")]
    trees = [manifest.hash_tree(side(r), 2) for r in (a, b)]
    got = {r.node for r in manifest.differing_leaves(*trees, 2).collect()}
    assert got == {leaf_of(i, 2) for i in (0, 700, 1400, 2100, 2800, 5, 9000)}
    assert manifest.differing_leaves(trees[0], trees[0], 2).isEmpty()
    root = trees[0].where("size = 0").first()
    assert root.hash == manifest.set_fingerprint(side(a), 2).first().fingerprint


def test_drift_equals_a_full_comparison(spark):
    rng = random.Random(6)
    trained = {i: (f"p{i}", i * 5) for i in range(900)}
    live = dict(trained)
    for i in rng.sample(range(900), 60):
        kind = rng.randrange(4)
        sha_, sig = live.pop(i)
        if kind == 0:
            live[i] = (sha_ + "x", sig ^ 1)
        elif kind == 1:
            live[i] = (sha_ + "y", sig ^ 0xFFFF)
        elif kind == 2:
            live[5000 + i] = (sha_, sig)
    live[7000] = ("fresh", 1)
    side = lambda rows: spark.createDataFrame([(i, s, [g]) for i, (s, g) in rows.items()], "icon_id bigint, sha256 string, sig array<bigint>")
    got = {r.icon_id: (r.status, r.new_id) for r in manifest.drift(side(trained), side(live), leaf=20).collect()}
    want = {}
    for i, (s, g) in trained.items():
        if i in live:
            same = "unchanged" if live[i][0] == s else "cosmetic" if (live[i][1] ^ g).bit_count() <= 4 else "changed"
            want[i] = (same, None)
        else:
            homes = [j for j, (t, _) in live.items() if t == s]
            want[i] = ("rekeyed", min(homes)) if homes else ("removed", None)
    want |= {i: ("new", None) for i in live if i not in trained}
    assert got == want


def test_a_plain_log_is_written_and_read_by_as_many_tasks_as_there_are(spark, monkeypatch):
    from slotvalue.plans.queries import QUERIES
    from slotvalue.sources import readers

    session, seen = spark.newSession(), []
    for key, value in {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}.items():
        session.conf.set(key, value)
    read = readers.read_plain_log
    monkeypatch.setattr(readers, "read_plain_log", lambda small, path: seen.append((small, path)) or read(small, path))
    assert QUERIES["plain_log_scan"](session, "/root/testdata/sf0.001").count() > 0
    small, path = seen[0]
    assert small.read.text(path).select("_metadata.file_path").distinct().count() > 2
    small.conf.set("spark.sql.files.maxPartitionBytes", "100b")
    assert small.read.text(path).rdd.getNumPartitions() <= 100
