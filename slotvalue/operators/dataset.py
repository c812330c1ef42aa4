"""Tables of a detector training set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.functions.geometry import large_enough, relative_box, whole_pixels
from slotvalue.functions.hashing import bernoulli, digest_number
from slotvalue.functions.rounding import six_decimals
from slotvalue.operators.skew import global_index, hashed_first, hashed_index, rank_within

# Share of turned icons, share of validation scenes, gap inside a cell in pixels.
TURNED = 0.5
VALIDATION = 0.1
INSET = 2


def canonical_class(icons: DataFrame, members: DataFrame) -> DataFrame:
    """Icons with their class key: the smallest icon of the duplicate group, or the icon."""
    roots = members.select("icon_id", "root")
    joined = icons.join(roots, "icon_id", "left")
    return joined.withColumn("ambiguous", F.col("root").isNotNull()).withColumn(
        "canonical", F.coalesce("root", "icon_id")
    ).drop("root")


def class_vocabulary(classed: DataFrame) -> DataFrame:
    """Dense class index per canonical icon, with the number of icons behind it."""
    keys = classed.groupBy("canonical").agg(
        F.count(F.lit(1)).alias("icons"), F.bool_or("ambiguous").alias("ambiguous")
    )
    return global_index(keys, [F.col("canonical")], "class_idx")


def class_members(classed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(class_idx, icon_id)``: the icons a class stands for, as rows."""
    return classed.join(vocabulary.select("canonical", "class_idx"), "canonical").select(
        "class_idx", "icon_id", "canonical"
    )


def replicate(icons: DataFrame, per_class: int) -> DataFrame:
    """Each icon ``per_class`` times, with the copy number."""
    return icons.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(per_class))))


def shuffled(
    df: DataFrame, seed: int, *key: str, out: str = "position", total: str | None = None
) -> DataFrame:
    """Repeatable permutation: 0-based position in the order of a seeded digest of ``key``."""
    keyed = df.withColumn("_digest", digest_number(seed, *[F.col(k) for k in key], digits=15))
    order = [F.col("_digest"), *[F.col(k) for k in key]]
    return hashed_index(keyed, "_digest", 60, order, out, total).drop("_digest")


def sample_first(df: DataFrame, seed: int, n: int, *key: str) -> DataFrame:
    """First ``n`` rows of the seeded permutation."""
    keyed = df.withColumn("_digest", digest_number(seed, *[F.col(k) for k in key], digits=15))
    order = [F.col("_digest"), *[F.col(k) for k in key]]
    return hashed_first(keyed, "_digest", 60, order, n).drop("_digest")


def chunked(queue: DataFrame, workers: int, position: str = "position", total: str = "total") -> DataFrame:
    """Consecutive chunks of ``ceil(n / workers)`` rows of a numbered queue of ``n`` rows."""
    return queue.withColumn("chunk", F.floor(F.col(position) / F.ceil(F.col(total) / workers)))


def scenes(queue: DataFrame, max_objs: int, position: str = "position") -> DataFrame:
    """At most ``max_objs`` consecutive placements per scene."""
    return queue.withColumn("scene", F.floor(F.col(position) / max_objs))


def split_scenes(df: DataFrame, seed: int, scene: str = "scene", share: float = VALIDATION) -> DataFrame:
    val = bernoulli(share, seed, "split", F.col(scene))
    return df.withColumn("split", F.when(val, "val").otherwise("train"))


def turned(df: DataFrame, seed: int, *key: str, share: float = TURNED) -> DataFrame:
    """Swap the footprint of a seeded share of the rows."""
    flag = bernoulli(share, seed, "turn", *[F.col(k) for k in key])
    return df.withColumns(
        {
            "turned": flag,
            "cells_w": F.when(flag, F.col("cells_h")).otherwise(F.col("cells_w")),
            "cells_h": F.when(flag, F.col("cells_w")).otherwise(F.col("cells_h")),
        }
    )


def label_box(grid_x: Column, grid_y: Column, cw: Column, ch: Column, col: Column, row: Column,
              cells_w: Column, cells_h: Column, image_w: Column, image_h: Column) -> Column:
    """Relative label of a footprint placed at a cell, shrunk by the inset on every side."""
    return relative_box(
        grid_x + col * cw + INSET,
        grid_y + row * ch + INSET,
        cells_w * cw - 2 * INSET,
        cells_h * ch - 2 * INSET,
        image_w,
        image_h,
    )


def label_line(class_idx: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.concat_ws(" ", class_idx.cast("string"), *[six_decimals(c) for c in (cx, cy, w, h)])


def corrections(events: DataFrame, detections: DataFrame, catalog: DataFrame) -> DataFrame:
    """A labelled sample for every box of the corrected icon in the session.

    ``events``: ``ts, session_id, icon_id, item_id``.  A correction without boxes gives nothing.
    """
    boxes = events.join(detections.select("session_id", "icon_id", "det_idx", "box"), ["session_id", "icon_id"])
    numbered = rank_within(boxes, ["session_id", "icon_id", "ts", "item_id"], [F.col("det_idx")], out="n")
    crop = F.concat(F.lit("crops/"), F.concat_ws("_", "session_id", "icon_id", F.col("n") - 1), F.lit(".png"))
    named = with_item_name(numbered, catalog)
    return named.select(
        "ts", F.col("session_id").alias("session"), crop.alias("crop"), "box", "icon_id", "item_id", "item_name"
    )


def with_item_name(df: DataFrame, catalog: DataFrame) -> DataFrame:
    names = catalog.select("item_id", F.col("name").alias("item_name"))
    return df.join(names, "item_id", "left").withColumn("item_name", F.coalesce("item_name", F.lit("")))


def missed_samples(drawn: DataFrame, catalog: DataFrame) -> DataFrame:
    """Boxes the detector missed, rounded to pixels, at least the minimum size, optionally labelled."""
    boxes = drawn.withColumn("box", whole_pixels(F.col("box"))).where(large_enough(F.col("box")))
    name = F.concat_ws("_", "session_id", F.array_join(F.transform("box", lambda v: v.cast("string")), "_"))
    named = with_item_name(boxes.withColumn("item_id", F.coalesce("item_id", F.lit(""))), catalog)
    return named.select(
        "ts",
        F.col("session_id").alias("session"),
        F.concat(F.lit("missed/"), name, F.lit(".png")).alias("crop"),
        "box",
        "item_id",
        "item_name",
    )


def with_gallery(placed: DataFrame, samples: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add real labelled crops (``icon_id`` known to the vocabulary) to generated placements."""
    real = samples.where(F.col("icon_id").isNotNull())
    known = real.join(vocabulary.select(F.col("canonical").alias("icon_id"), "class_idx"), "icon_id")
    generated = placed.select("icon_id", "class_idx", F.lit("generated").alias("origin"), F.lit(None).cast("string").alias("crop"))
    return generated.unionByName(known.select("icon_id", "class_idx", F.lit("gallery").alias("origin"), "crop"))
