"""Append logs, snapshots and training-set files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotvalue.operators.dataset import label_line
from slotvalue.runtime import freed_shuffles, scratch_path

# Fixed value: certainty of an event written by hand.
MANUAL_CERTAINTY = 100


def manual_events(corrections: DataFrame) -> DataFrame:
    """Log lines for hand-made links.  ``corrections``: ``seq, ts, icon_id, item_id`` and ``note``."""
    note = F.coalesce("note", F.lit("")) if "note" in corrections.columns else F.lit("")
    return corrections.select(
        "seq",
        F.col("ts").cast("string").alias("ts"),
        F.col("icon_id").cast("string").alias("icon_id"),
        "item_id",
        F.lit("manual").alias("source"),
        F.lit(MANUAL_CERTAINTY).alias("certainty"),
        note.alias("note"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON line per row; existing lines are never touched."""
    rows.write.mode("append").option("ignoreNullFields", False).json(path)


def write_snapshot(rows: DataFrame, label: str) -> str:
    """Write a table to a new versioned path and return the path."""
    path = scratch_path(rows.sparkSession, label)
    with freed_shuffles(rows.sparkSession):
        rows.write.mode("errorifexists").parquet(path)
    return path


def write_labels(labels: DataFrame, path: str) -> None:
    """Label lines by split: the scene, a tab, and ``class cx cy w h`` with six decimals.

    A folder per split only; the lines of a scene are together and scenes are in order.
    """
    line = label_line(*[F.col(c) for c in ("class_idx", "cx", "cy", "w", "h")])
    lines = labels.select("split", "scene", F.concat_ws("\t", F.col("scene").cast("string"), line).alias("value"))
    lines = lines.repartitionByRange("split", "scene").sortWithinPartitions("split", "scene")
    lines.select("split", "value").write.partitionBy("split").text(path)


def read_labels(spark: SparkSession, path: str, scene: str = "int") -> DataFrame:
    """``(split, scene, value)`` of written labels."""
    lines = spark.read.schema("value string, split string").text(path)
    parts = F.split("value", "\t", 2)
    return lines.select("split", parts[0].cast(scene).alias("scene"), parts[1].alias("value"))


def class_metadata(vocabulary: DataFrame) -> DataFrame:
    """One JSON line per class: index, name, ambiguity and the number of icons behind it."""
    name = F.col("canonical").cast("string").alias("name")
    return vocabulary.select(F.to_json(F.struct("class_idx", name, "ambiguous", "icons")).alias("value"))


def class_icon_lines(members: DataFrame) -> DataFrame:
    """One JSON line per icon of a class; a class can have any number of icons."""
    return members.select(F.to_json(F.struct("class_idx", "icon_id")).alias("value"))
