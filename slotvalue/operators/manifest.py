"""Content manifests, fingerprints and drift."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.functions.hashing import hamming
from slotvalue.functions.text import model_and_version
from slotvalue.runtime import checkpoint, scratch_path

# Gradient-hash distance up to which a changed file counts as the same picture.
COSMETIC_BITS = 4
# Lines of a leaf of a hash tree, about, and the depth of the trees in release manifests.
LEAF_LINES = 256
RELEASE_DEPTH = 4
# Fixed value: oldest application version that can load a release.
MIN_VERSION = "0.1.0"


def missing_assets(trained: DataFrame, cached: DataFrame) -> DataFrame:
    return trained.join(cached.select("icon_id"), "icon_id", "left_anti")


def ordered_distinct(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position of their first occurrence."""
    return rows.groupBy(value).agg(F.min(position).alias("first_pos"))


def line_of(icon: str = "icon_id", digest: str = "sha256"):
    return F.concat(F.col(icon).cast("string"), F.lit(":"), F.col(digest))


def small_set_fingerprint(assets: DataFrame, keys: list[str]) -> DataFrame:
    """Release fingerprint: SHA-256 over the sorted ``id:sha256`` lines of each key.

    The digest of one text needs the whole text, so this is for the icon sets of single
    models (thousands of short lines).  ``set_fingerprint`` covers sets of any size.
    """
    lines = F.array_sort(F.collect_list(line_of()))
    return assets.groupBy(*keys).agg(
        F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("icons")
    )


def tree_depth(lines: int, leaf: int = LEAF_LINES) -> int:
    """Levels of 16 children below the root at which a leaf holds about ``leaf`` lines at most."""
    depth = 0
    while lines > leaf * 16**depth:
        depth += 1
    return depth


def _leaf_of(icon: str, depth: int) -> Column:
    return F.substring(F.md5(F.col(icon).cast("string")), 1, depth) if depth else F.lit("")


def _leaves(assets: DataFrame, depth: int, keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, node, hash, icons)``: a leaf hashes its sorted lines."""
    return assets.groupBy(*keys, _leaf_of("icon_id", depth).alias("node")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(line_of())), "\n"), 256).alias("hash"), F.count(F.lit(1)).alias("icons")
    )


def _parents(level: DataFrame, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """The nodes of ``size`` digits over those of one digit more: a parent hashes its sorted ``digit:hash`` lines."""
    child = F.concat(F.substring("node", size + 1, 1), F.lit(":"), F.col("hash"))
    return level.groupBy(*keys, F.substring("node", 1, size).alias("node")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(child)), "\n"), 256).alias("hash"), F.sum("icons").alias("icons")
    )


def set_fingerprint(assets: DataFrame, depth: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Fingerprint of a set of any size, or of the set of each key, as a hash tree.

    Lines fall into ``16**depth`` leaves by the first hex digits of the MD5 of their id.  The depth is part of the
    definition; without one it follows from the number of lines (of the largest key), so that leaves stay at about
    ``LEAF_LINES`` lines however large the set is.  No task sees more than one leaf or 16 child hashes of a node.
    """
    if depth is None:
        counts = assets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else assets.agg(F.count(F.lit(1)).alias("n"))
        depth = tree_depth(counts.agg(F.max("n")).first()[0] or 0)
    level = _leaves(assets, depth, keys)
    for size in range(depth - 1, -1, -1):
        level = _parents(level, size, keys)
    return level.select(*keys, F.col("hash").alias("fingerprint"), "icons")


def hash_tree(assets: DataFrame, depth: int) -> DataFrame:
    """``(size, node, hash)`` of all nodes, written once; ``size`` is the number of digits of a node."""
    spark = assets.sparkSession
    leaves = scratch_path(spark, "leaves")
    _leaves(assets, depth).write.parquet(leaves)
    level, levels = spark.read.parquet(leaves), []
    for size in range(depth, -1, -1):
        level = level if size == depth else _parents(level, size)
        levels.append(level.select(F.lit(size).alias("size"), "node", "hash"))
    path = scratch_path(spark, "tree")
    reduce(DataFrame.unionByName, levels).write.partitionBy("size").parquet(path)
    return spark.read.schema("node string, hash string, size int").parquet(path)


def differing_leaves(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """``(node)`` of the leaves that two trees of one depth do not share.

    Compared from the root down; below a node with equal hashes nothing is looked at.
    """
    nodes = None
    for size in range(depth + 1):
        left, right = (t.where(F.col("size") == size).select("node", F.col("hash").alias(n)) for t, n in ((a, "left"), (b, "right")))
        if nodes is not None:
            parents = nodes.withColumnRenamed("node", "parent")
            left, right = (t.join(parents, F.substring("node", 1, size - 1) == F.col("parent"), "left_semi") for t in (left, right))
        nodes = checkpoint(left.join(right, "node", "full_outer").where(~F.col("left").eqNullSafe(F.col("right"))).select("node"))
        if nodes.isEmpty():
            break
    return nodes


def release_summary(trained: DataFrame, cached: DataFrame) -> DataFrame:
    """Classes, distinct icons, hashed icons and missing icons of each model."""
    have = cached.select("icon_id", F.lit(1).alias("cached"))
    icons = trained.groupBy("model", "icon_id").agg(F.count(F.lit(1)).alias("classes"))
    joined = icons.join(have, "icon_id", "left")
    return joined.groupBy("model").agg(
        F.sum("classes").alias("classes"),
        F.count(F.lit(1)).alias("unique_icons"),
        F.count("cached").alias("icon_count"),
        F.count_if(F.col("cached").isNull()).alias("icons_missing"),
    )


def release_manifest(
    trained: DataFrame, cached: DataFrame, built_at: str, min_version: str = MIN_VERSION, files: DataFrame | None = None
) -> DataFrame:
    """One row per released model: name, version, counts, fingerprint of its icons, and digests of its files.

    ``trained``: ``model, icon_id`` per class; ``cached``: ``icon_id, sha256`` per icon; ``files``: ``model, file,
    sha256`` of every file that is released.  ``files`` of a model are in order of their names; without the table the
    column is left out.
    """
    icons = trained.select("model", "icon_id").distinct().join(cached.select("icon_id", "sha256"), "icon_id")
    prints = set_fingerprint(icons, RELEASE_DEPTH, ["model"]).drop("icons")
    rows = release_summary(trained, cached).join(prints, "model", "left")
    own = []
    if files is not None:
        listed = files.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("file", "sha256"))).alias("files"))
        rows, own = rows.join(listed, "model", "left"), ["files"]
    return rows.withColumn("named", model_and_version(F.col("model"))).select(
        F.col("model").alias("name"),
        "named.model",
        "named.version",
        "classes",
        "icon_count",
        "icons_missing",
        F.col("fingerprint").alias("icons_fingerprint"),
        F.lit(built_at).alias("built_at"),
        F.lit(min_version).alias("min_app_version"),
        *own,
    )


def drift(trained: DataFrame, live: DataFrame, cosmetic: int = COSMETIC_BITS, leaf: int = LEAF_LINES) -> DataFrame:
    """Compare the icons a model was trained on with the current ones.

    Both sides: ``icon_id, sha256, sig``.  Status: ``unchanged``, ``cosmetic`` (other bytes,
    near picture), ``changed``, ``rekeyed`` (gone, but its bytes live under another id),
    ``removed`` and ``new``.  ``new_id`` is the smallest id that carries the old bytes.

    Both sides become hash trees of one depth.  Icons in leaves with equal hashes are unchanged and are not joined; only the
    rows of differing leaves meet.
    """
    spark, paths = trained.sparkSession, []
    for side in (trained, live):
        paths.append(scratch_path(spark, "icons"))
        side.select("icon_id", "sha256", "sig").write.parquet(paths[-1])
    trained, live = (spark.read.parquet(p) for p in paths)
    depth = tree_depth(max(trained.count(), live.count()), leaf)
    leaves = differing_leaves(hash_tree(trained, depth), hash_tree(live, depth), depth).withColumnRenamed("node", "_leaf")
    moved_in = lambda df, how: df.withColumn("_leaf", _leaf_of("icon_id", depth)).join(leaves, "_leaf", how)
    t = moved_in(trained, "left_semi").select("icon_id", F.col("sha256").alias("t_sha"), F.col("sig").alias("t_sig"))
    c = moved_in(live, "left_semi").select("icon_id", F.col("sha256").alias("c_sha"), F.col("sig").alias("c_sig"))
    nobody = F.lit(None).cast(trained.schema["icon_id"].dataType).alias("new_id")
    same = moved_in(trained, "left_anti").select("icon_id", F.lit("unchanged").alias("status"), nobody)
    both = t.join(c, "icon_id", "full_outer").withColumn("bits", hamming(F.col("t_sig"), F.col("c_sig")))
    # A digest shared by many icons is reduced to one row on both sides before joining.
    gone = both.where(F.col("c_sha").isNull()).select("t_sha").distinct()
    home = live.join(gone, F.col("sha256") == F.col("t_sha"), "left_semi").groupBy(F.col("sha256").alias("t_sha"))
    moved = home.agg(F.min("icon_id").alias("new_id"))
    stay = both.where(F.col("t_sha").isNotNull() & F.col("c_sha").isNotNull()).select(
        "icon_id",
        F.when(F.col("t_sha") == F.col("c_sha"), "unchanged")
        .when(F.col("bits") <= cosmetic, "cosmetic")
        .otherwise("changed")
        .alias("status"),
        nobody,
    )
    left = both.where(F.col("c_sha").isNull()).join(moved, "t_sha", "left").select(
        "icon_id", F.when(F.col("new_id").isNull(), "removed").otherwise("rekeyed").alias("status"), "new_id"
    )
    fresh = both.where(F.col("t_sha").isNull()).select("icon_id", F.lit("new").alias("status"), nobody)
    return same.unionByName(stay).unionByName(left).unionByName(fresh)


def worklist(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items with an image link whose file is absent or empty.  ``files``: ``item_id, length``."""
    wanted = items.where(F.coalesce(F.col("link"), F.lit("")) != "")
    return wanted.join(files.where(F.col("length") > 0).select("item_id"), "item_id", "left_anti")
