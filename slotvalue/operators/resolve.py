"""Decide what each detection is and what it is worth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.functions.pricing import cells, effective_value, value_per_slot
from slotvalue.operators.links import with_certainty
from slotvalue.operators.skew import present_key, spread_missing


def item_entries(catalog: DataFrame, basis: str = "avg24h") -> DataFrame:
    """Catalog columns a result needs; the value is computed once per item, not per detection."""
    value = effective_value(F.col("avg24h"), F.col("low"), F.col("vendor"), F.col("base"), basis)
    return catalog.select(
        "item_id",
        "name",
        F.coalesce("short", F.lit("")).alias("short"),
        cells(F.col("width")).alias("width"),
        cells(F.col("height")).alias("height"),
        value.alias("value"),
    )


ENTRY = ["name", "short", "width", "height", "value"]


def _entry(prefix: str) -> list[Column]:
    """Item columns of one side, flat, so that those that a result does not need are left out before the shuffles."""
    return [F.col("item_id").alias(f"{prefix}id"), *[F.col(f).alias(prefix + f) for f in ENTRY]]


def visual_candidates(links: DataFrame, items: DataFrame) -> DataFrame:
    """Icon to item by the link map; links to unknown items are dropped."""
    joined = with_certainty(links).join(items.hint("shuffle_hash"), "item_id")
    return joined.select("icon_id", *_entry("_v_"), "score", "margin", "override", F.col("certainty").alias("_certainty"))


def resolve(
    detections: DataFrame, links: DataFrame, catalog: DataFrame, basis: str = "avg24h", keep: Sequence[str] = ()
) -> DataFrame:
    """Fuse the visual and the text identity of every detection.

    The visual side wins unless the text score is strictly higher.  Unidentified
    detections stay in the result with null item columns.  Further detection columns
    pass through when named in ``keep``.
    """
    items = item_entries(catalog, basis)
    named = items.select(F.col("item_id").alias("ocr_id"), present_key(F.col("item_id")).alias("_salt"), F.lit(True).alias("_named"), *_entry("_o_")[1:])
    # Many detections carry no text; their empty keys are spread over the join.
    salted = detections.withColumn("_salt", spread_missing(F.col("ocr_id"), F.col("session_id"), F.col("det_idx")))
    # The right sides have one row per icon and item: a task hashes its share of them and streams the detections unsorted.  The
    # planner takes a catalog of ids for small by its file and would send it whole to all tasks.
    by_link = visual_candidates(links, items).hint("shuffle_hash")
    # The text first: it finds fewer items and adds fewer columns, so less travels to the second join.
    both = salted.join(named.hint("shuffle_hash"), ["ocr_id", "_salt"], "left").drop("_salt").join(by_link, "icon_id", "left")
    # An icon that was found has an id, so a null id tells that there was none.
    by_icon, by_name = F.col("_v_id").isNotNull(), F.col("_named").isNotNull()
    both = both.withColumn("_o_id", F.when(by_name, F.col("ocr_id")))
    text_score = F.coalesce("ocr_score", F.lit(0.0))
    # The decision is a column of its own, so it is computed once per row.
    both = both.withColumn("_seen", by_icon & (~by_name | (F.col("_certainty") >= text_score)))
    seen = F.col("_seen")
    visual = F.struct(*[F.col(f"_v_{f}").alias(f) for f in ("id", "name", "short", "width", "height")], "score", "margin", "override", F.col("_certainty").alias("certainty"))

    def text_field(field):
        return F.coalesce(f"_o_{field}", F.lit("")).alias(field)

    records = both.select(
        "session_id",
        "det_idx",
        "icon_id",
        "box",
        "det_conf",
        *keep,
        F.when(seen & F.col("override"), "override").when(seen, "yolo").when(by_name, "ocr").alias("source"),
        F.when(seen, F.col("_certainty")).when(by_name, text_score).otherwise(0.0).alias("certainty"),
        F.coalesce(F.col("_v_id") == F.col("_o_id"), F.lit(False)).alias("agree"),
        F.when(by_icon, visual).alias("yolo"),
        F.struct(
            *[text_field(f) for f in ("id", "name", "short")],
            F.col("_o_width").alias("width"),
            F.col("_o_height").alias("height"),
            text_score.alias("score"),
            F.coalesce("ocr_raw", F.lit("")).alias("raw"),
        ).alias("ocr"),
        *[F.when(seen, F.col(f"_v_{f}")).otherwise(F.col(f"_o_{f}")).alias(f) for f in ("id", *ENTRY)],
    )
    slots = F.col("width") * F.col("height")
    return records.withColumn("slots", slots).withColumn("per_slot", value_per_slot(F.col("value"), slots))


def identified(records: DataFrame) -> DataFrame:
    return records.where(F.col("source").isNotNull())


def unidentified(records: DataFrame) -> DataFrame:
    return records.where(F.col("source").isNull())


def detections_of(records: DataFrame) -> DataFrame:
    """Back to raw detections.  A text item that left the catalog stays lost (empty id)."""
    return records.select(
        "session_id",
        "det_idx",
        "icon_id",
        "box",
        "det_conf",
        F.col("ocr.id").alias("ocr_id"),
        F.col("ocr.score").alias("ocr_score"),
        F.col("ocr.raw").alias("ocr_raw"),
    )


def all_records(found: DataFrame, unknown: DataFrame) -> DataFrame:
    """Identified and unidentified rows as one table."""
    return found.unionByName(unknown, allowMissingColumns=True)
